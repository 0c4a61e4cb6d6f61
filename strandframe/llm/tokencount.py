"""Token counts of whole documents, however long, by overlap resynchronisation.

A document is encoded in overlapping chunks of CHUNK_CHARS with offsets. Two neighbours are spliced at a position of their
overlap where both have a token boundary and which is proven stable: no piece of the vocabulary holds the two
characters beside it next to each other, so no merge can ever cross it, whatever else the text holds. Where an
overlap has no such position it is widened, up to the end of the document if need be.

Defined results: null and empty texts have no tokens; repeated rows are counted each by itself; an empty table
gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import map_texts

CHUNK_CHARS = 1 << 10
OVERLAP_CHARS = 64
BLANK = "▁"


class PieceEncoder:
    """A sentencepiece model that can be spliced: one that leaves texts as they are, without a normaliser or symbols of
    its user's. Others are refused with an error, for nothing is proven about their seams."""

    def __init__(self, path: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = chunk, overlap
        with open(path, "rb") as f:
            proto = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        normal, byte = proto.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece.BYTE
        own = sentencepiece_model_pb2.ModelProto.SentencePiece.USER_DEFINED
        self.pairs: set[str] = set()
        used: set[str] = set()
        lengths = []
        for piece in proto.pieces:
            surface = piece.piece.replace(BLANK, " ")
            lengths.append(1 if piece.type == byte else len(surface.encode()))
            if piece.type != byte:
                self.pairs.update(surface[i : i + 2] for i in range(len(surface) - 1))
                used.update(surface)
        self.lengths = np.array(lengths, np.int64)
        #: Stands before a chunk that doesn't begin its document; in no piece, so nothing merges with it.
        self.mark = next((c for c in "\n\r\x1e\x1f" if c not in used), None)
        if not (
            not normal.precompiled_charsmap and not normal.remove_extra_whitespaces and normal.add_dummy_prefix
            and normal.escape_whitespaces and proto.trainer_spec.byte_fallback and self.mark is not None
            and not any(p.type == own for p in proto.pieces) and proto.trainer_spec.model_type == 2
        ):
            raise ValueError(f"{path}: only BPE models with byte fallback that leave texts as they are can be spliced")
        self.lead = len(self.model.encode(self.mark))  # the blank put before a text, and the mark

    def stable(self, text: str, at: int) -> bool:
        """No token of any text that holds these two characters here crosses the place between them."""
        return text[at - 1 : at + 1] not in self.pairs

    def _part(self, text: str, start: int, end: int) -> tuple[list[int], np.ndarray]:
        """Tokens of a chunk and the byte offset, from start, at which each ends."""
        if start == 0:
            ids = self.model.encode(text[:end])
            ends = np.cumsum(self.lengths[ids]) - 1  # the blank put before the text is no part of it
        else:
            ids = self.model.encode(self.mark + text[start:end])[self.lead :]
            ends = np.cumsum(self.lengths[ids])
        return ids, ends

    def splices(self, text: str) -> Iterator[list[int]]:
        """The token ids of the text, by chunk. Each chunk is encoded once, and again only where its overlap is widened."""
        text = text.replace(BLANK, " ")  # the model takes a blank for this sign: the same tokens, but plain offsets
        n = len(text)
        start = told = passed = 0  # a chunk's first character; its bytes, and characters, that are told of already
        end = min(n, self.chunk + self.overlap)
        ids, ends = self._part(text, 0, end)
        while end < n:
            seam = start + max(self.chunk, passed)  # where the next chunk starts
            far = min(n, seam + self.chunk + self.overlap)
            next_ids, next_ends = self._part(text, seam, far)
            before = len(text[start:seam].encode())
            overlap = self.overlap
            while (found := self._splice(text, seam, end, max(told - before, 0), ends - before, next_ends)) is None:
                if end == n:  # no place is proven: this chunk has become the rest of the document
                    break
                overlap *= 2
                end = max(end, min(n, seam + overlap))
                if end > far:
                    far = min(n, end + self.overlap)
                    next_ids, next_ends = self._part(text, seam, far)
                ids, ends = self._part(text, start, end)
            first = int(np.searchsorted(ends, told, "right")) if told else 0
            if found is None:
                yield ids[first:]
                return
            yield ids[first : int(np.searchsorted(ends, before + found[0], "right"))]
            start, (told, passed), end, ids, ends = seam, found, far, next_ids, next_ends
        yield ids[int(np.searchsorted(ends, told, "right")) if told else 0 :]

    def _splice(self, text: str, seam: int, end: int, told: int, ends: np.ndarray, following: np.ndarray) -> tuple[int, int] | None:
        """The first place beyond what is told, in bytes and characters from the seam, that ends a token of both chunks
        and is proven stable."""
        mine = ends[np.searchsorted(ends, told, "right") :]
        common = np.intersect1d(mine, following[: np.searchsorted(following, int(ends[-1]), "right")]) if len(mine) else mine
        at = offset = 0
        shared = text[seam:end].encode()
        for place in common.tolist():
            if 0 < place < len(shared) and shared[place] & 0xC0 != 0x80:
                at += len(shared[offset:place].decode())
                offset = place
                if self.stable(text, seam + at):
                    return place, at
        return None

    def ids(self, text: str) -> list[int]:
        return [i for part in self.splices(text) for i in part]

    def count(self, text: str) -> int:
        return sum(map(len, self.splices(text)))


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """One for each worker process."""
    return PieceEncoder(path)


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for each document; model_path is read on the executors."""

    def row(doc_id: object, text: bytes | None, model: PieceEncoder) -> tuple:
        n = model.count(text.decode()) if text else 0
        return doc_id, len(text or b""), n, n > limit

    kind = docs.schema["doc_id"].dataType.simpleString().replace("bigint", "long")
    return map_texts(
        docs.select("doc_id", F.col("text").cast("string").alias("text")), ["doc_id", "text"], row,
        f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean", lambda: encoder(model_path),
    )
