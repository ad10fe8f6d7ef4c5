import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from codeskein.schema import EDGES, NODES, conform
from codeskein.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "codeskein-tests", spark__sql__shuffle__partitions="4")
    if session.conf.get("spark.checkpoint.dir", None) is None:
        session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="codeskein-tests-"))
    return session


def node_frame(spark, rows: list[dict]):
    """Nodes from dicts; fields left out are NULL."""
    fields = {f.name: None for f in NODES.fields}
    return spark.createDataFrame([{**fields, **row} for row in rows], NODES)


def edge_frame(spark, rows: list[tuple]):
    """Edges from (source, target, type[, ord])."""
    data = [(r[0], r[1], r[2], r[3] if len(r) > 3 else 0) for r in rows]
    return conform(spark.createDataFrame(data, "source_id string, target_id string, type string, ord int"), EDGES)


@pytest.fixture(scope="session")
def small_graph(spark):
    """One file with a class, its method and a helper that the method calls."""
    nodes = node_frame(
        spark,
        [
            {"id": "file:test.py", "type": "file", "name": "test.py", "path": "test.py", "language": "python"},
            {"id": "class:test.py:MyClass", "type": "class", "name": "MyClass", "file_id": "file:test.py",
             "start_line": 1, "end_line": 20},
            {"id": "func:test.py:module:helper", "type": "function", "name": "helper", "file_id": "file:test.py",
             "start_line": 22, "end_line": 25, "signature": ""},
            {"id": "func:test.py:MyClass:method", "type": "function", "name": "method", "file_id": "file:test.py",
             "start_line": 5, "end_line": 10, "is_method": True, "class_id": "class:test.py:MyClass", "signature": ""},
        ],
    )
    edges = edge_frame(
        spark,
        [
            ("file:test.py", "class:test.py:MyClass", "defines"),
            ("file:test.py", "func:test.py:module:helper", "defines"),
            ("class:test.py:MyClass", "func:test.py:MyClass:method", "contains"),
            ("func:test.py:MyClass:method", "func:test.py:module:helper", "calls"),
        ],
    )
    return nodes, edges
