"""Work on Arrow batches in short-lived children of a Python worker."""

from __future__ import annotations

import gc
import os
import traceback
from collections.abc import Callable, Iterator

import pyarrow as pa

#: Rows and bytes after which a child's work is enough.
CHILD_ROWS = 20_000
CHILD_BYTES = 32 << 20


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= CHILD_ROWS or sum(b.nbytes for b in held) >= CHILD_BYTES:
            yield held
            held = []
    if held:
        yield held


def in_children(
    work: Callable[[list[pa.RecordBatch]], Iterator[pa.RecordBatch]], batches: Iterator[pa.RecordBatch], schema: pa.Schema
) -> Iterator[pa.RecordBatch]:
    """`work` on portions of the batches, each in a forked child that sends its batches (of `schema`) back through a pipe.

    What the work leaves in memory goes with the child. Its batches are passed on as they come. A child that fails is an error here.
    """
    for portion in _portions(batches):
        out, into = os.pipe()
        child = os.fork()
        if child == 0:
            code = 1
            try:
                os.close(out)
                gc.disable()  # syntax trees have no cycles, and the child is gone soon
                with os.fdopen(into, "wb") as pipe, pa.ipc.new_stream(pipe, schema) as stream:
                    for batch in work(portion):
                        stream.write_batch(batch)
                code = 0
            except BrokenPipeError:  # no more is wanted
                pass
            except BaseException:
                os.write(2, traceback.format_exc().encode())
            finally:
                os._exit(code)
        os.close(into)
        done = False
        try:
            with os.fdopen(out, "rb") as pipe, pa.ipc.open_stream(pipe) as stream:
                yield from stream
                done = True
        except pa.ArrowInvalid as error:
            raise RuntimeError("a reader's process ended early; see the worker's error output") from error
        finally:
            status = os.waitpid(child, 0)[1]
        if done and status:
            raise RuntimeError(f"a reader's process ended with status {status}; see the worker's error output")
