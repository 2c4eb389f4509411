import ast
import pathlib

ROOT = pathlib.Path(__file__).parent.parent


def imports(path):
    for node in ast.walk(ast.parse(path.read_text())):
        if isinstance(node, ast.ImportFrom) and node.module:
            yield node.module
        elif isinstance(node, ast.Import):
            yield from (a.name for a in node.names)


def test_nothing_but_the_entry_imports_the_llm_package():
    for path in [*(ROOT / "millrace").rglob("*.py"), *(ROOT / "tests").rglob("*.py"), ROOT / "bench.py"]:
        if "llm" not in path.relative_to(ROOT).parts:
            assert not [m for m in imports(path) if m.startswith("millrace.llm")], path


def test_no_checkpoint_that_dies_with_an_executor():
    for path in (ROOT / "millrace").rglob("*.py"):
        assert "localCheckpoint" not in path.read_text(), path
