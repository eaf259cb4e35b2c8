"""Token counts by a public tokenizer."""

from __future__ import annotations

import base64
import re
import sys
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread_scan

#: Where the public vocabularies lie, and the one to count with.
FOLDER, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
_BLANKS = re.compile(r"[^\S\x1c-\x1f]{1000,}")


@lru_cache(maxsize=4)
def _encoder(path: str):
    import importlib.util
    import os

    import tiktoken

    spec = importlib.util.spec_from_file_location("public_tokenizers", os.path.join(os.path.dirname(path), "__init__.py"))
    about = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(about)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=about.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: str | None, path: str) -> int:
    """Tokens of a whole text. Very long runs of white space, on which the pattern would run out of stack, are encoded as
    the one piece the pattern makes of them: all of the run but the last character, which goes with what follows."""
    if not text:
        return 0
    encoder = _encoder(path)
    total, at = 0, 0
    for m in _BLANKS.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        total += len(encoder.encode_ordinary(text[at : m.start()])) + len(encoder._encode_single_piece(text[m.start() : end]))
        at = end
    return total + len(encoder.encode_ordinary(text[at:] if at else text))


def token_counts(df: DataFrame, key: str, text: str = "text", keep: tuple[str, ...] = (), path: str = f"{FOLDER}/{VOCABULARY}") -> DataFrame:
    """key, the kept columns and n_tokens of every row. Null and empty texts have none."""
    columns = [key, *keep]
    source = spread_scan(df.select(*columns, F.col(text).alias("_text")))
    ddl = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in columns) + ", n_tokens long"

    def run(batches):
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 3000))
        for b in batches:
            n = pa.array([count(t, path) for t in b.column(len(columns)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(columns)], n], names=[*columns, "n_tokens"])

    return source.mapInArrow(run, ddl)
