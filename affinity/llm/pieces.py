"""SentencePiece merge-type (BPE) encoding by backtracking, and decoding.

A sequence of pieces is the encoding of its text exactly if each piece, and each pair of neighbours,
re-merges to itself. So the encoder walks the text with the longest matching piece that agrees with
the piece before it, takes the next shorter one where that fails, and marks positions from which
nothing fits: what precedes a position is unique, so a failed position never needs a second try.
"""

import re
import sys

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPACE = "▁"
CACHED = 60_000
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6


def read_model(path: str) -> dict:
    """Pieces of a merge-type model file. Only what this encoder does exactly is accepted: identity
    normalization, a dummy prefix, escaped spaces, byte fallback, normal pieces."""
    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    trainer, rules = model.trainer_spec, model.normalizer_spec
    kinds = {p.type for p in model.pieces}
    if (trainer.model_type != trainer.BPE or not trainer.byte_fallback or trainer.treat_whitespace_as_suffix
            or rules.precompiled_charsmap or not rules.add_dummy_prefix or not rules.escape_whitespaces
            or rules.remove_extra_whitespaces or not kinds <= {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}):
        raise ValueError(f"not a plain merge-type model with byte fallback: {path}")
    return {
        "pieces": [(p.piece, i, p.score) for i, p in enumerate(model.pieces) if p.type == _NORMAL],
        "bytes": [i for i, p in enumerate(model.pieces) if p.type == _BYTE],
    }


def kind(sign: str) -> str:
    return "space" if sign == SPACE else "letter" if sign.isalpha() else "other"


class _Recent(dict):
    """What ``make`` gives for a key. When full it becomes the older of two generations, from which
    keys still in use come back."""

    def __init__(self, make, bound: int):
        self.make, self.bound, self.older = make, bound, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.bound:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class PieceEncoder:
    """Codes texts by chunks that no merge crosses."""

    def __init__(self, model: dict, cached: int = CACHED):
        self.score = {piece: score for piece, _, score in model["pieces"]}
        self.ids = {piece: i for piece, i, _ in model["pieces"]}
        self.text = {i: piece.replace(SPACE, " ").encode() for piece, i, _ in model["pieces"]}
        self.bytes = model["bytes"]
        self.text |= {i: bytes([n]) for n, i in enumerate(self.bytes)}
        self.match = ahocorasick.Automaton()
        self.shorter = {}  # the next shorter piece, or else sign, that begins a piece
        for piece in self.ids:
            self.match.add_word(piece, (piece, len(piece) - 1))
            ends = (piece[:n] for n in range(len(piece) - 1, 0, -1))
            self.shorter[piece] = next((p for p in ends if p in self.ids or len(p) == 1), None)
        self.match.make_automaton()
        self.pairs = _Recent(lambda pair: self.remerged("".join(pair)) == list(pair), cached + cached // 4)
        self.alone: dict[str, bool] = {}
        self.coded = _Recent(self.of_chunk, cached)
        # Merges stop between two signs that no piece holds side by side. The pattern cuts there by
        # kinds of signs, as far as the pieces keep to them.
        side = {(kind(a), kind(b)) for piece in self.ids for a, b in zip(piece, piece[1:])}
        known = {c for piece in self.ids for c in piece} - {SPACE}
        letters = re.escape("".join(sorted(c for c in known if c.isalpha())))
        others = re.escape("".join(sorted(c for c in known if not c.isalpha())))
        if side & {("letter", "space"), ("other", "space")}:
            pattern = "(?s).+"
        elif side & {("letter", "other"), ("other", "letter")}:
            pattern = f"{SPACE}*[{letters}{others}]+|{SPACE}+|[^{SPACE}]"
        else:
            pattern = f"{SPACE}*(?:[{letters}]+|[{others}]+)|{SPACE}+|[^{SPACE}]"
        self.chunks = re.compile(pattern, re.S).findall

    def remerged(self, text: str) -> list[str]:
        """What merging the signs of ``text`` by score, leftmost first among equals, gives."""
        parts = list(text)
        while True:
            best, at = None, 0
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def agree(self, left: str | None, right: str) -> bool:
        if left is None:
            known = self.alone.get(right)
            if known is None:
                known = self.alone[right] = len(self.remerged(right)) == 1
            return known
        return self.pairs[left, right]

    def split(self, chunk: str) -> list[str]:
        """Pieces of a chunk, single signs that are no piece included."""
        n, longest = len(chunk), list(chunk)
        for end, (piece, before) in self.match.iter(chunk):  # ends ascend, so the longest comes last
            longest[end - before] = piece
        failed = bytearray(n // 8 + 1)
        taken: list[str] = []
        shorter, agree = self.shorter, self.agree
        before, at, piece = None, 0, longest[0]
        while at < n:
            while piece is not None:
                end = at + len(piece)
                if not failed[end >> 3] >> (end & 7) & 1 and agree(before, piece):
                    break
                piece = shorter.get(piece)
            if piece is not None:
                taken.append(piece)
                before, at = piece, end
                piece = longest[at] if at < n else None
            else:
                failed[at >> 3] |= 1 << (at & 7)
                piece = taken.pop()
                before = taken[-1] if taken else None
                at -= len(piece)
                piece = shorter.get(piece)
        return taken

    def decode(self, ids: list[int]) -> str:
        """Text of ids; the space that the encoder put before the text is not removed here."""
        return b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "replace")

    def of_chunk(self, chunk: str) -> tuple[bytes, str]:
        """Ids of a chunk as int32 bytes, and its decoded text."""
        ids: list[int] = []
        for piece in self.split(chunk):
            known = self.ids.get(piece)
            ids += [known] if known is not None else [self.bytes[b] for b in piece.encode()]
        return np.array(ids, np.int32).tobytes(), self.decode(ids)

    def encode(self, text: str | None) -> tuple[bytes, str]:
        """Ids as int32 bytes, and the text that decoding them gives."""
        if not text:
            return b"", ""
        coded = list(map(self.coded.__getitem__, self.chunks(SPACE + text.replace(" ", SPACE))))
        return b"".join([ids for ids, _ in coded]), "".join([part for _, part in coded])[1:]


def encode_documents(docs: DataFrame, model_path: str, cached: int = CACHED) -> DataFrame:
    """(doc_id, ids, decoded): piece ids of each whole text, and the text that they decode to.

    Equal to the library's ``encode`` without begin and end ids, and its ``decode``. Null and empty
    texts have no ids and decode to an empty text. Each row is coded alone: repeated and null
    ids stay, other columns are dropped, an empty table gives no rows. A task remembers up to twice ``cached``
    chunks of text, for speed only.
    """
    model = read_model(model_path)

    def coded(batches):
        encoder = PieceEncoder(model, cached)
        for batch in batches:
            rows = [encoder.encode(text) for text in batch.column(1).to_pylist()]
            ends = np.cumsum([0] + [len(ids) // 4 for ids, _ in rows], dtype=np.int32)
            values = pa.array(np.frombuffer(b"".join([ids for ids, _ in rows]), np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), values),
                 pa.array([text for _, text in rows], pa.string())],
                names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        coded, "doc_id bigint, ids array<int>, decoded string")


def digests(coded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what ``encode_documents`` returns."""
    return coded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
