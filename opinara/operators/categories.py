"""Categories of products by the words in their names, found by one automaton over all words.

The automaton is built once on the driver, as a table of a size known before (states by kinds of characters), and goes along with the function. A batch of names
passes through it character by character, all names at once, so that the time of a name doesn't depend on how many words there are.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import categories as CT, text as TX

#: Cells of the automaton's table.
MAX_CELLS = 1 << 26


class Automaton:
    """Aho-Corasick over ``words``: which of them a text contains."""

    def __init__(self, words: list[str]):
        self.words = list(dict.fromkeys(words))
        self.kinds = {c: i for i, c in enumerate(sorted({c for w in self.words for c in w}), 1)}  # 0: any other character
        children: list[dict[int, int]] = [{}]
        ends: list[list[int]] = [[]]
        for n, word in enumerate(self.words):
            at = 0
            for c in word:
                if (kind := self.kinds[c]) not in children[at]:
                    children[at][kind] = len(children)
                    children.append({})
                    ends.append([])
                at = children[at][kind]
            ends[at].append(n)
        if len(children) * (len(self.kinds) + 1) > MAX_CELLS:
            raise ValueError(f"{len(self.words)} words make an automaton of {len(children)} states over {len(self.kinds)} characters")
        self.step = np.zeros((len(children), len(self.kinds) + 1), np.int32)
        self.found = np.zeros((len(children), -(-max(1, len(self.words)) // 8)), np.uint8)
        fallback = [0] * len(children)
        waiting = deque([0])
        while waiting:  # from short to long prefixes: a state's fallback is finished before it
            at = waiting.popleft()
            self.step[at] = self.step[fallback[at]]
            self.found[at] |= self.found[fallback[at]]
            for n in ends[at]:
                self.found[at, n // 8] |= 128 >> n % 8
            for kind, child in children[at].items():
                fallback[child] = int(self.step[fallback[at], kind]) if at else 0
                self.step[at, kind] = child
                waiting.append(child)

    def contained(self, texts: list[str]) -> np.ndarray:
        """texts x words: whether the text contains the word."""
        order = np.argsort([-len(t) for t in texts], kind="stable")
        held = np.zeros((len(texts), self.found.shape[1]), np.uint8)
        state = np.zeros(len(texts), np.int32)
        sizes = np.array([len(texts[i]) for i in order])
        kinds = [np.fromiter(map(lambda c: self.kinds.get(c, 0), texts[i]), np.int32, len(texts[i])) for i in order]
        flat, first = np.concatenate([np.zeros(0, np.int32), *kinds]), np.cumsum(sizes) - sizes
        for k in range(int(sizes.max(initial=0))):
            n = int(np.searchsorted(-sizes, -k, "left"))  # texts of more than k characters come first
            state[:n] = self.step[state[:n], flat[first[:n] + k]]
            held[:n] |= self.found[state[:n]]
        out = np.empty((len(texts), len(self.words)), bool)
        out[order] = np.unpackbits(held, axis=1)[:, : len(self.words)]
        return out


class Rules:
    """Words of categories with an automaton over all of them."""

    def __init__(self, words: dict[str, list[str]], strong: dict[str, list[str]], generic: list[str], other: str):
        rows = [(k, w.lower(), w in strong.get(c, []), w not in generic) for k, (c, ws) in enumerate(words.items()) for w in ws]
        self.automaton = Automaton([w for _, w, _, _ in rows])
        self.place = np.array([self.automaton.words.index(w) for _, w, _, _ in rows], int)
        self.size = np.array([len(w) for _, w, _, _ in rows])
        self.category, self.strong, self.specific = (np.array([r[i] for r in rows]) for i in (0, 2, 3))
        self.names = np.array([*words, other], object)

    def _hits(self, texts: pd.Series) -> np.ndarray:
        return self.automaton.contained(texts.fillna("").tolist())[:, self.place]

    def best(self, texts: pd.Series) -> pd.Series:
        """Most strong words, then the longest of them, most words that aren't generic, the longest of them, most words, the category's place."""
        hits = self._hits(texts)
        scores = np.zeros((len(texts), len(self.names) - 1), np.int64)
        for c in range(len(self.names) - 1):
            own = hits & (self.category == c)
            for use in (self.strong, self.specific):
                scores[:, c] = scores[:, c] * 1024 + np.minimum(1023, (own & use).sum(axis=1))
                scores[:, c] = scores[:, c] * 1024 + np.minimum(1023, np.where(own & use, self.size, 0).max(axis=1, initial=0))
            scores[:, c] = np.where(own.any(axis=1), scores[:, c] * 1024 + np.minimum(1023, own.sum(axis=1)), -1)
        found = scores.max(axis=1, initial=-1)
        return pd.Series(self.names[np.where(found >= 0, scores.argmax(axis=1), len(self.names) - 1)])

    def first(self, texts: pd.Series) -> pd.Series:
        """The first category of which any word is there."""
        hits = self._hits(texts)
        least = np.where(hits, self.category, len(self.names) - 1).min(axis=1, initial=len(self.names) - 1)
        return pd.Series(self.names[least])


def _rule(kind: str, words, strong, generic, other):
    rules = Rules(words, strong, generic, other)

    @F.pandas_udf(T.StringType())
    def guess(texts: pd.Series) -> pd.Series:
        return getattr(rules, kind)(texts)

    return guess


def guess(name: Column, words: dict[str, list[str]] = CT.WORDS, strong: dict[str, list[str]] = CT.STRONG, generic: list[str] = CT.GENERIC, other: str = CT.OTHER) -> Column:
    """The category whose words fit a name best; ``other`` where none does."""
    return _rule("best", words, strong, generic, other)(F.lower(TX.nfkc(F.coalesce(name, F.lit("")))))


def former_guess(name: Column, words: dict[str, list[str]] | None = None, other: str = CT.OTHER) -> Column:
    """The former rule: the first category in order of which some word is in the name."""
    return _rule("first", CT.former_words() if words is None else words, {}, [], other)(F.lower(TX.nfkc(F.coalesce(name, F.lit("")))))


def audit(names: DataFrame, name: str) -> DataFrame:
    """product_name, old_category, new_category: each name once, white space squeezed, by both rules; names without text go."""
    once = names.select(TX.squeeze(F.col(name)).alias("product_name")).where("product_name <> ''").distinct()
    return once.select("product_name", former_guess(F.col("product_name")).alias("old_category"), guess(F.col("product_name")).alias("new_category"))


def resolve(products: DataFrame, labels: DataFrame | None, key: Column, given: Column | None, name: Column) -> DataFrame:
    """With ``category``: a label's (key, category), if it is one of the known categories; else the one given; else the words' guess. Of labels of one key the last (``line``) counts."""
    rule = guess(name)
    if given is not None:
        rule = F.coalesce(F.nullif(given, F.lit("")), rule)
    if labels is None:
        return products.withColumn("category", rule)
    known = labels.where(TX.squeeze(F.col("category")).isin(CT.CATEGORIES) & F.col("key").rlike("^[0-9a-f]{64}$"))
    known = known.groupBy(F.col("key").alias("_k")).agg(F.max_by(TX.squeeze(F.col("category")), "line" if "line" in labels.columns else F.lit(0)).alias("_label"))
    return products.withColumns({"_key": key, "_rule": rule}).join(known, F.col("_key") == F.col("_k"), "left").withColumn("category", F.coalesce("_label", "_rule")).drop("_k", "_key", "_label", "_rule")
