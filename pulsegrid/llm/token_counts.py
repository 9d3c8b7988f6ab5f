"""Token counts: Arrow functions encode batches of about equal bytes and return lengths only."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: A place between two pre-tokens of every byte-level BPE: a blank between two ASCII letters.
SAFE = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")
#: The pre-token pattern of byte-level BPE (a fixed value of that format).
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters outside the range where all Unicode versions agree on letters, digits and white space.
UNUSUAL = re.compile("[^\t\n\r\x20-\x7e\xa1-ɏ]")
#: Entries of a worker's memo of pre-token lengths, and their greatest length; it starts anew when full. Longer ones are not kept.
MEMO, MEMO_LENGTH = 400_000, 64


def pieces(text: str, size: int) -> Iterator[str]:
    """``text`` cut at safe boundaries, each piece at least ``size`` characters but the last."""
    at = 0
    while len(text) - at > size and (m := SAFE.search(text, at + size)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def byte_batches(texts: list[str], size: int) -> Iterator[list[int]]:
    """Runs of row numbers whose texts hold about ``size`` UTF-8 bytes together."""
    run, held = [], 0
    for i, text in enumerate(texts):
        run.append(i)
        held += len(text) if text.isascii() else len(text.encode())
        if held >= size:
            yield run
            run, held = [], 0
    if run:
        yield run


class Counter:
    """Lengths as the tokenizers library gives them.

    Where the file describes plain byte-level BPE, pre-tokens of usual characters are encoded once and
    remembered; texts with unusual characters or a special token's string go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.encoder.no_truncation()
        self.encoder.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        byte_level = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        self.plain = bool(byte_level and not spec.get("normalizer"))
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.splitter = regex.compile(PRETOKEN)
        self.memo: dict[str, int] = {}

    def usual(self, text: str) -> bool:
        return self.plain and not UNUSUAL.search(text) and not any(s in text for s in self.special)

    def lengths(self, texts: list[str]) -> list[int]:
        out, whole = [0] * len(texts), []
        split: list[tuple[int, list[str]]] = []
        for i, text in enumerate(texts):
            if self.usual(text):
                split.append((i, self.splitter.findall(text)))
            else:
                whole.append(i)
        used = set().union(*(tokens for _, tokens in split))
        if len(self.memo) + len(used - self.memo.keys()) > MEMO:
            self.memo.clear()
        new = list(used - self.memo.keys())
        self.memo.update(zip(new, map(len, self.encoder.encode_batch_fast(new, add_special_tokens=False))))
        for i, tokens in split:
            out[i] = sum(map(self.memo.__getitem__, tokens))
        for token in new:
            if len(token) > MEMO_LENGTH:
                del self.memo[token]
        for i, got in zip(whole, self.encoder.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False)):
            out[i] = len(got)
        return out


def token_counts(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, batch_bytes: int = 1 << 19, piece_chars: int = 1 << 16
) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` for every row.

    A null or empty text has 0 bytes and 0 tokens; repeated rows are counted each; other columns are ignored.
    Texts longer than ``piece_chars`` are cut between two pre-tokens (plain byte-level BPE only), which leaves
    the count unchanged. Narrow: no shuffle; a worker holds one batch and a bounded memo.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(tokenizer_path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            owner, parts = [], []
            for i, text in enumerate(texts):
                for p in pieces(text, piece_chars) if counter.plain else [text]:
                    owner.append(i)
                    parts.append(p)
            n_tokens = [0] * len(texts)
            for rows in byte_batches(parts, batch_bytes):
                for i, n in zip(rows, counter.lengths([parts[i] for i in rows])):
                    n_tokens[owner[i]] += n
            n_bytes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
