"""Posts from a demo, a store of JSON lines or a folder of pages, behind one call, in batch and as a stream.

``BoardSource`` is a Spark data source, short name ``opinara_board``, with an option ``kind``. ``lines`` splits files by bytes and tells of each line its file, the
start of its split and its place there; a line belongs to the split its first byte is in. ``pages`` gives whole files, several per
task. As a stream, a store is followed line by line as it is appended to: an offset is how many whole lines' bytes of each file have been read, so a line
that is still being written waits for its end. Paths are those that Arrow's file systems open: a shared folder, or a store's URI.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "opinara_board"
LINES = "file string, split long, place long, at long, ended boolean, value string"
PAGES = "url string, html string, at timestamp"
POSTS = "value string"
SPLIT, WINDOW = 32 << 20, 1 << 20


def _files(path: str, ends: tuple[str, ...]) -> list[tuple[str, int]]:
    """Names and sizes of the files of a path, in order; those that begin with a dot or a low line aren't data."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith(("file:", "/")) else (fs.LocalFileSystem(), path)
    found = store.get_file_info(inner)
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    infos = [found] if found.type == fs.FileType.File else store.get_file_info(fs.FileSelector(inner, recursive=True))
    hidden = lambda p: any(x.startswith((".", "_")) for x in p.removeprefix(inner).split("/"))
    return sorted((i.path, i.size) for i in infos if i.type == fs.FileType.File and not hidden(i.path) and i.path.endswith(ends))


def _open(path: str, name: str):
    from pyarrow import fs

    store = fs.FileSystem.from_uri(path)[0] if "://" in path or path.startswith(("file:", "/")) else fs.LocalFileSystem()
    return store.open_input_file(name)


class Split(InputPartition):
    def __init__(self, name: str, start: int, end: int):
        super().__init__((name, start, end))
        self.name, self.start, self.end = name, start, end


class Group(InputPartition):
    def __init__(self, names: list[str]):
        super().__init__(names)
        self.names = names


def _lines(path: str, split: Split) -> Iterator[tuple]:
    """Lines whose first byte is in the split, a window of bytes at a time."""
    with _open(path, split.name) as f:
        at = split.start
        f.seek(at)
        if at:  # the line that runs into the split belongs to the one before
            f.seek(at - 1)
            while (piece := f.read(WINDOW)) and b"\n" not in piece:
                at = f.tell()
            at = f.tell() - len(piece) + piece.index(b"\n") + 1 if piece else f.tell()
            f.seek(at)
        rest, place = b"", 0
        while at < split.end:
            piece = f.read(WINDOW)
            data = rest + piece
            parts = data.split(b"\n")
            rest = parts.pop()
            for line in parts:
                if at >= split.end:
                    return
                yield split.name, split.start, place, at, True, line.removesuffix(b"\r").decode("utf-8", "replace")
                at += len(line) + 1
                place += 1
            if not piece:
                if rest and at < split.end:
                    yield split.name, split.start, place, at, False, rest.decode("utf-8", "replace")
                return


class BoardReader(DataSourceReader):
    def __init__(self, options: dict):
        self.kind, self.path, self.size = options.get("kind", "demo"), options.get("path"), int(options.get("split", SPLIT))

    def partitions(self):
        if self.kind == "demo":
            return [Group([])]
        if self.kind == "lines":
            return [Split(n, s, min(s + self.size, size)) for n, size in _files(self.path, ("",)) for s in range(0, size, self.size)] or [Group([])]
        groups: list[list[str]] = [[]]
        total = 0
        for n, size in _files(self.path, (".html", ".htm")):
            if groups[-1] and total + size > self.size:
                groups.append([])
                total = 0
            groups[-1].append(n)
            total += size
        return [Group(g) for g in groups]

    def read(self, partition):
        if self.kind == "demo":
            yield from ((json.dumps(p, ensure_ascii=False),) for p in demo_posts())
        elif self.kind == "lines":
            if isinstance(partition, Split):
                yield from _lines(self.path, partition)
        else:
            for n in partition.names:
                with _open(self.path, n) as f:
                    yield n, f.read().decode("utf-8", "replace"), None


class LinesStream(DataSourceStreamReader):
    """Lines that were appended since, each once; what a file's last line still lacks is left for later."""

    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("split", SPLIT))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        try:
            return {n: end for n, size in _files(self.path, ("",)) if (end := self._whole(n, size))}
        except FileNotFoundError:
            return {}

    def _whole(self, name: str, size: int) -> int:
        """The place behind the last line's end."""
        with _open(self.path, name) as f:
            end = size
            while end > 0:
                start = max(0, end - WINDOW)
                f.seek(start)
                if (k := f.read(end - start).rfind(b"\n")) >= 0:
                    return start + k + 1
                end = start
        return 0

    def partitions(self, start: dict, end: dict):
        return [Split(n, s, min(s + self.size, e)) for n, e in sorted(end.items()) for s in range(start.get(n, 0), e, self.size)]

    def read(self, partition):
        yield from _lines(self.path, partition)


class BoardSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return {"demo": POSTS, "lines": LINES, "pages": PAGES}[self.options.get("kind", "demo")]

    def reader(self, schema) -> BoardReader:
        return BoardReader(self.options)

    def streamReader(self, schema) -> LinesStream:
        if self.options.get("kind") != "lines":
            raise ValueError("only lines can be followed")
        return LinesStream(self.options)


def demo_posts() -> list[dict]:
    """Four posts with 25 comments: an author's own push, an account that returns, an empty text, a chorus that cries shill, undated and neutral ones."""
    at = dt.datetime(2024, 5, 1, 12)
    said = {
        "demo-1": ("全家", "海鹽焦糖布丁", "45", "mimi", 85.0, "焦糖微苦，布丁很滑，會回購。", [("推", "kai", "好吃推薦"), ("推", "mimi", "我自己先推"), ("→", "kai", "甜度剛好"), ("噓", "zoe", "太甜了不好吃"), ("推", "lulu", ""), ("推", "noa", "比小7好吃"), ("→", "pan", "我家附近買不到")]),
        "demo-2": ("7-11", "炙燒鮭魚飯糰", "39", "ben", 60.0, "飯有點乾，鮭魚量普通。", [("→", "kai", "普通"), ("噓", "ray", "難吃又貴"), ("推", "sue", "份量夠"), ("推", "sue", "下次還會買"), ("→", "tom", "小7的比較好吃"), ("噓", "uma", "失望")]),
        "demo-3": ("7-11", "黑糖珍珠雪糕", "35", "amy", 95.0, "珍珠很Q，超好吃。", [("推", "x1", "業配吧"), ("噓", "x2", "葉配"), ("噓", "x3", "業配文"), ("→", "x4", "又是業配"), ("推", "kai", "珍珠好吃"), ("推", "zoe", "驚豔")]),
        "demo-4": ("萊爾富", "蒜香雞排", "59", "leo", None, "", [("推", "kai", "香"), ("→", "wes", "原來這麼難吃"), ("推", "yan", "酥脆推薦"), ("噓", "leo", "自己補噓"), ("推", "ian", "不錯"), ("→", None, "無名")]),
    }
    posts = []
    for i, (key, (brand, product, price, author, score, review, comments)) in enumerate(said.items()):
        when = at + dt.timedelta(days=i)
        posts.append({
            "id": key, "source": "demo", "board": "CVS", "url": f"https://board.example/{key}.html", "title": f"[商品] {brand} {product}", "brand": brand, "product_name": product, "price": price, "author": author, "author_score": score,
            "review_text": review, "posted_at": when.isoformat(), "is_reply": False, "push_count": len(comments), "raw": {"fields": {"商品名稱": product}},
            "comments": [{"tag": t, "user": u, "text": x, "posted_at": None if n == 2 else (when + dt.timedelta(minutes=10 * n)).isoformat(), "sentiment": None, "backend": "lexicon"} for n, (t, u, x) in enumerate(comments)],
        })
    return posts


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BoardSource)


def numbered_lines(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """file, line (from 1 in each file, blank ones counted), value, ended: exact however files were split; a split's number of lines is all that is gathered of it."""
    from pyspark.sql import Window

    register(spark)
    rows = spark.read.format(NAME).option("kind", "lines").option("split", split).load(path)
    sizes = rows.groupBy("file", "split").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("file", "split", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.join(starts, ["file", "split"]).select("file", (F.col("_before") + F.col("place") + 1).alias("line"), "value", "ended")


def line_faults(spark: SparkSession, path: str, schema: str, split: int = SPLIT) -> DataFrame:
    """file, line, fault, value: lines that are no JSON object of the schema; the last one of a file without an end is told apart (cut_off)."""
    rows = numbered_lines(spark, path, split).where(F.trim("value") != "")
    parsed = F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    bad = rows.withColumn("p", parsed).where(F.col("p._bad").isNotNull() | F.col("p.id").isNull())
    return bad.select("file", "line", F.when(F.col("ended"), "bad").otherwise("cut_off").alias("fault"), "value")


def open_posts(spark: SparkSession, kind: str = "demo", path: str | None = None, schema: str | None = None, split: int = SPLIT) -> DataFrame:
    """Posts of a ``demo``, of a ``stored`` file or folder of JSON lines (the last line of an id, brands told anew), or of ``pages``. A bad stored line is an error that names file and line."""
    from . import posts as P, threads

    register(spark)
    schema = schema or P.POST_SCHEMA
    if kind == "demo":
        return spark.read.format(NAME).load().select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("p")).select("p.*")
    if kind not in ("stored", "pages"):
        raise ValueError(f"posts come from demo, stored or pages, not {kind}")
    if not path:
        raise ValueError(f"{kind} posts need a path")
    if kind == "pages":
        return threads.parse_threads(spark.read.format(NAME).option("kind", "pages").load(path))
    if bad := line_faults(spark, path, schema, split).orderBy("file", "line").limit(5).collect():
        raise ValueError("; ".join(f"{r['file']}:{r['line']} {r['fault']} {r['value'][:80]!r}" for r in bad))
    rows = numbered_lines(spark, path, split).where(F.trim("value") != "").select("file", "line", F.from_json("value", schema).alias("p"))
    return P.last_stored(rows)


def follow_posts(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A stream of a store's posts as they are appended; lines that can't be read are left to ``line_faults``."""
    from . import posts as P

    register(spark)
    rows = spark.readStream.format(NAME).option("kind", "lines").load(path)
    return rows.select(F.from_json("value", schema or P.POST_SCHEMA).alias("p")).where("p.id is not null").select("p.*")
