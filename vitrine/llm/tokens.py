"""Sizes of texts in tokens of a public tokenizer, read from a vocabulary file."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Folder of vocabulary files; a parameter everywhere, nothing is copied.
TOKENIZERS = os.environ.get("VITRINE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: How the vocabulary's tokenizer cuts texts into words. A fixed value that belongs to the vocabulary.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

@lru_cache(maxsize=4)
def _encoding(path: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for raw, rank in ranks.items():
        lengths[rank] = len(raw)
    return tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}), lengths


def loss_marks(text: str, starts: np.ndarray) -> np.ndarray:
    """Which tokens bear loss: those of every other line, from the second on; all of a text of one line. starts: the tokens' first bytes."""
    lines = text.splitlines(keepends=True)
    if len(lines) < 2:
        return np.ones(len(starts), dtype=bool)
    begins = np.cumsum([0] + [len(x.encode()) for x in lines[:-1]])
    return (np.searchsorted(begins, starts, side="right") - 1) % 2 == 1


def sized(df: DataFrame, text: str, vocabulary: str | None = None, loss: bool = False) -> DataFrame:
    """Adds n_tokens; with loss also n_loss and loss_spans, the runs of loss-bearing tokens as array<struct<a,b>>, b exclusive.

    As in instruction data, turns alternate: a line asks, the next one answers, and only answers bear
    loss. Null and empty texts have 0 tokens. Whole texts are encoded, in Arrow batches.
    """
    path = vocabulary or os.path.join(TOKENIZERS, VOCABULARY)
    kept = [c for c in df.columns if c not in (text, "n_tokens", "n_loss", "loss_spans")]
    base = df.select(*kept, text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields if f.name != text)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding, lengths = _encoding(path)
        for pdf in batches:
            n, borne, spans = [], [], []
            for t in pdf[text]:
                ids = encoding.encode_ordinary(t) if isinstance(t, str) else []
                n.append(len(ids))
                if loss:
                    size = lengths[ids]
                    marks = loss_marks(t, np.cumsum(size) - size) if ids else np.zeros(0, dtype=bool)
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], marks.view(np.int8), [0]])))
                    borne.append(int(marks.sum()))
                    spans.append([{"a": int(a), "b": int(b)} for a, b in zip(edges[::2], edges[1::2])])
            out = pdf[kept].assign(n_tokens=n)
            yield out.assign(n_loss=borne, loss_spans=spans) if loss else out

    return base.mapInPandas(encode, f"{schema}, n_tokens long" + (", n_loss long, loss_spans array<struct<a:long,b:long>>" if loss else ""))
