"""Every module can be the first that is imported."""

import pathlib
import subprocess
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parent.parent
MODULES = sorted(".".join(p.relative_to(ROOT).with_suffix("").parts) for p in (ROOT / "opinara").rglob("*.py") if p.name != "__init__.py" and "llm" not in p.parts)


@pytest.mark.parametrize("part", range(4))
def test_modules_import_alone(part):
    code = "import importlib, os, sys\nfor m in sys.argv[1:]:\n    pid = os.fork()\n    if not pid:\n        try:\n            importlib.import_module(m)\n        except BaseException as e:\n            print(m, repr(e), flush=True)\n            os._exit(1)\n        os._exit(0)\n    assert os.waitpid(pid, 0)[1] == 0, m\n"
    done = subprocess.run([sys.executable, "-c", code, *MODULES[part::4]], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stdout + done.stderr
