"""SentencePiece BPE encoding by a prefix table, and decoding.

Every prefix of a text has one last token: the token t ending there for which the last token of the prefix
before t and t stay apart when their joined text is merged. An automaton lists the tokens ending at each
place, a memo holds the pair tests, and the ids are recovered backwards from the end.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

META = "▁"
#: Longest unit that is merged pair by pair, which is faster for one that is not in the memo.
SHORT = 32
#: Distinct units and pairs that a worker remembers; each memo starts anew when full.
MEMO_UNITS, MEMO_PAIRS = 500_000, 600_000


class PieceCodec:
    """Encodes and decodes with a SentencePiece BPE model that normalises nothing but blanks."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        norm, kinds = spec.normalizer_spec, proto.ModelProto.SentencePiece
        if spec.trainer_spec.model_type != proto.TrainerSpec.BPE or norm.name != "identity" or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only BPE models that keep white space and do not normalise characters are supported")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in spec.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.prefix = META if norm.add_dummy_prefix else ""
        self.ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == kinds.NORMAL}
        self.score = {p.piece: p.score for p in spec.pieces if p.type == kinds.NORMAL}
        hexed = {int(p.piece[3:-1], 16): i for i, p in enumerate(spec.pieces) if p.type == kinds.BYTE}
        self.bytes = [hexed[b] for b in range(256)] if len(hexed) == 256 else None
        self.unk = spec.trainer_spec.unk_id
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        surface = {i: spec.trainer_spec.unk_surface.encode() if p.type == kinds.UNKNOWN else b"" for i, p in enumerate(spec.pieces) if p.type in (kinds.UNKNOWN, kinds.CONTROL)}
        by_byte = {i: bytes([b]) for b, i in hexed.items()}
        self.surface = [surface.get(i, by_byte.get(i, p.piece.replace(META, " ").encode())) for i, p in enumerate(spec.pieces)]
        # No merge crosses a character that no longer piece holds, nor from another character to a blank unless a piece does.
        longer = [p for p in self.ids if len(p) > 1]
        inside = {c for p in longer for c in p}
        if any(META in p.lstrip(META) for p in longer):
            self.units = re.compile("(?s).+")
        elif "\n" in inside:
            self.units = re.compile(f"(?s){META}*[^{META}]+|{META}+")
        else:
            self.units = re.compile(f"{META}*[^{META}\n]+|{META}+|\n")
        self.known: dict[str, list[int]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.library = sentencepiece.__version__

    def merged(self, text: str) -> list[str]:
        """Merges pair by pair: the best score first, the leftmost of equals. For short texts: each merge looks through the scores of all neighbours."""
        symbols, get, none = list(text), self.score.get, float("-inf")
        scores = [get(a + b, none) for a, b in zip(symbols, symbols[1:])]
        while scores:
            best = max(scores)
            if best == none:
                break
            at = scores.index(best)
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            del scores[at]
            if at < len(scores):
                scores[at] = get(symbols[at] + symbols[at + 1], none)
            if at:
                scores[at - 1] = get(symbols[at - 1] + symbols[at], none)
        return symbols

    def apart(self, left: str, right: str) -> bool:
        """Whether the two tokens stay two tokens when their joined text is encoded."""
        key = (left, right)
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            got = self.pairs[key] = self.merged(left + right) == [left, right]
        return got

    def encode_short(self, unit: str) -> list[int]:
        out: list[int] = []
        for token in self.merged(unit):
            got = self.ids.get(token)
            if got is not None:
                out.append(got)
            elif self.bytes:
                out.extend(self.bytes[b] for b in token.encode())
            else:
                out.append(self.unk)
        return out

    def encode_unit(self, unit: str) -> list[int]:
        if len(unit) <= SHORT:
            return self.encode_short(unit)
        last: list[str | None] = [None] * (len(unit) + 1)
        apart = self.apart
        for end, piece in self.automaton.iter(unit):
            if last[end + 1] is None:
                start = end + 1 - len(piece)
                if start == 0 or apart(last[start] or unit[start - 1], piece):
                    last[end + 1] = piece
        out, at = [], len(unit)
        while at:
            token = last[at] or unit[at - 1]
            got = self.ids.get(token)
            if got is not None:
                out.append(got)
            elif self.bytes:
                out.extend(self.bytes[b] for b in reversed(token.encode()))
            else:
                out.append(self.unk)
            at -= len(token)
        out.reverse()
        return out

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        known, out = self.known, []
        for unit in self.units.findall((self.prefix + text).replace(" ", META)):
            got = known.get(unit)
            if got is None:
                got = self.encode_unit(unit)
                if len(unit) <= 40:
                    if len(known) >= MEMO_UNITS:
                        known.clear()
                    known[unit] = got
            out += got
        return out

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.surface.__getitem__, ids))
        if self.prefix and ids and self.surface[ids[0]].startswith(b" "):
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


@lru_cache(maxsize=1)
def loaded(model_path: str) -> PieceCodec:
    """The codec of a worker process, which its later tasks find with what it remembers."""
    return PieceCodec(model_path)


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)`` and, ``with_ids``, ``ids`` and ``decoded``, for every row.

    A null text counts as empty: no ids, an empty decoding. Repeated rows are encoded each; other columns are
    ignored. Narrow: no shuffle; a worker holds one batch and two bounded memos, which it keeps from task to task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = loaded(model_path)
        digits = [str(i) for i in range(len(codec.surface))]
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                out: list[list] = [[] for _ in range(5)]
                for text in part.column(1).to_pylist():
                    ids = codec.encode(text or "")
                    decoded = codec.decode(ids)
                    row = (len(ids), hashlib.sha256(",".join(map(digits.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), ids, decoded)
                    for column, value in zip(out, row if with_ids else row[:3]):
                        column.append(value)
                kinds = [pa.int64(), pa.string(), pa.string()] + [pa.list_(pa.int32()), pa.string()] * with_ids
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(v, k) for v, k in zip(out, kinds))], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"] * with_ids]
                )

    kind = docs.schema[id_col].dataType.simpleString()
    more = ", ids array<int>, decoded string" if with_ids else ""
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
