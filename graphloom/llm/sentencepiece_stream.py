"""SentencePiece encoding and decoding with a streaming Viterbi search.

The search runs over boundaries between characters. Each boundary keeps one backpointer, the last piece of the surviving
path that ends there, and only boundaries within the longest piece of the current position can still be left by a piece.
Once the paths of all of those meet in one boundary, everything before it is decided: its ids are committed and
forgotten, so the retained window does not grow with the text.

What survives at a boundary depends on the kind of model. In a unigram model it is the path with the largest sum of piece
scores. A BPE model's scores are merge ranks, whose sum means nothing and does not reproduce the model's own ids; there a
path survives if merging leaves every two neighbouring pieces as they are, and exactly one path to each boundary does.
Both give the ids of the sentencepiece library.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

SPACE = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_UNIGRAM, _BPE = 1, 2
#: Entries that a worker's caches hold before they are emptied.
CACHE_ENTRIES = 300_000


class Model:
    """A SentencePiece model file with the identity normaliser, of type unigram or BPE."""

    def __init__(self, data: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(data)
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only models that keep their text as it is are supported")
        if proto.trainer_spec.model_type not in (_UNIGRAM, _BPE) or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only unigram and BPE models with leading white space marks are supported")
        if any(p.type not in (_NORMAL, _UNKNOWN, _CONTROL, _BYTE) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.bpe = proto.trainer_spec.model_type == _BPE
        self.prefix = spec.add_dummy_prefix
        self.pieces = [p.piece for p in proto.pieces]
        self.types = [p.type for p in proto.pieces]
        self.scores = [p.score for p in proto.pieces]
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == _NORMAL}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == _BYTE}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == _UNKNOWN)
        self.longest = max(map(len, self.ids))
        self.unknown_score = min((self.scores[i] for i in self.ids.values()), default=0.0) - 10.0
        #: True if a mark only ever begins a piece, so a path has a boundary before each run of marks.
        self.cut_at_marks = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        #: The same of line feeds, which then stand alone.
        self.cut_at_lines = not any("\n" in p for p in self.ids)
        #: The longest piece by its last two characters.
        self._reach: dict[str, int] = {}
        for p in self.ids:
            self._reach[p[-2:]] = max(len(p), self._reach.get(p[-2:], 1))
        self._stable: dict[tuple[str, str], bool] = {}
        self._backpointers: dict[str, int] = {}
        self._halves: dict[int, list[str]] = {}
        self._starts: dict[str, list] = {}
        self._ends: dict[str, list] = {}
        self._words: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        #: What each id adds to a decoded text, in UTF-8.
        self._decoded = [
            bytes((int(p[3:5], 16),)) if t == _BYTE else " ⁇ ".encode() if t == _UNKNOWN else p.replace(SPACE, " ").encode() if t == _NORMAL else b""
            for p, t in zip(self.pieces, self.types, strict=True)
        ]
        parts = (f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if self.cut_at_lines else f"{SPACE}*[^{SPACE}]+|{SPACE}+") if self.cut_at_marks else "(?s).+"
        self._split = re.compile(parts).findall

    # -- BPE ---------------------------------------------------------------------------------------------------------

    def merged(self, text: str) -> list[str]:
        """The pieces that merging makes of a short text: best score first, then leftmost."""
        parts, ids, scores = list(text), self.ids, self.scores
        while True:
            best = None
            for i in range(len(parts) - 1):
                k = ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or scores[k] > best[0]):
                    best = (scores[k], i)
            if best is None:
                return parts
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def _chain(self, piece: str, right: bool) -> list[tuple[str, float]]:
        """The pieces that the right (or left) end of a piece has been, latest first, each with the score at which it is used up."""
        chain, until = [], float("-inf")
        while True:
            chain.append((piece, until))
            if len(piece) == 1:
                return chain
            k = self.ids[piece]
            until = self.scores[k]
            if k not in self._halves:
                parts = list(piece)
                while len(parts) > 2:
                    i = max(range(len(parts) - 1), key=lambda i: (self.scores[self.ids[p]] if (p := parts[i] + parts[i + 1]) in self.ids else float("-inf"), -i))
                    parts[i : i + 2] = [parts[i] + parts[i + 1]]
                self._halves[k] = parts
            piece = self._halves[k][right]

    def stable(self, left: str, right: str) -> bool:
        """Whether merging leaves these neighbours as they are.

        It does not if a piece that the left one's end has been and one that the right one's start has been make a piece that
        scores above the merges that use them up. Pieces of marks only share one score, so those are merged in full.
        """
        known = self._stable.get((left, right))
        if known is None:
            if len(self._stable) >= CACHE_ENTRIES:
                self._stable.clear()
            if left[-1] == SPACE or right.startswith(SPACE + SPACE) or len(left) > 1 and left not in self.ids:
                known = self.merged(left + right) == [left, right]
            else:
                starts = self._starts.get(right)
                if starts is None:
                    starts = self._starts[right] = self._chain(right, False)
                ends = self._ends.get(left)
                if ends is None:
                    ends = self._ends[left] = self._chain(left, True)
                known, ids, scores = True, self.ids, self.scores
                for a, over in ends:
                    for b, least in starts:
                        k = ids.get(a + b)
                        if k is not None and scores[k] > over and scores[k] >= least:
                            known = False
                            break
                    if not known:
                        break
            self._stable[left, right] = known
        return known

    # -- the search --------------------------------------------------------------------------------------------------

    def _pointer(self, text: str, start: int, end: int, left: str, last: dict) -> int:
        """A BPE model's backpointer of boundary ``end``; those of a text's beginning are looked at as they are needed."""
        ids, known = self.ids, self._stable
        # No piece that ends in these two characters is longer than their reach.
        reach = self._reach.get(text[end - 2 : end], 1) if end - start > 1 else 1
        for begin in range(max(start, end - reach), end):
            piece = text[begin:end]
            if piece in ids or begin == end - 1:
                before = left if begin == start else text[last[begin] if begin in last else self._shared(text[:begin]) : begin]
                if not before or (self.stable(before, piece) if (fits := known.get((before, piece))) is None else fits):
                    return begin
        raise AssertionError("a boundary without a path")

    def _shared(self, text: str) -> int:
        """The backpointer at the end of a beginning that is no longer than the longest piece; it depends on nothing else, so it is remembered."""
        begin = self._backpointers.get(text)
        if begin is None:
            begin = self._backpointers[text] = self._pointer(text, 0, len(text), "", {})
        return begin

    def _extend(self, text: str, start: int, first: int, stop: int, left: str, last: dict, cost: dict) -> None:
        """Set the backpointers of boundaries ``first`` to ``stop``: where the surviving path's last piece begins.

        ``left`` is the piece before ``start`` ("" at the text's start).
        """
        ids, scores = self.ids, self.scores
        if self.bpe:
            for end in range(first, stop + 1):
                last[end] = self._pointer(text, start, end, left, last)
            return
        for end in range(first, stop + 1):
            best = None
            for begin in range(max(start, end - self.longest), end):
                if begin not in cost:
                    continue
                k = ids.get(text[begin:end])
                score = scores[k] if k is not None else self.unknown_score if begin == end - 1 else None
                if score is not None and (best is None or cost[begin] + score > best):
                    best = cost[end] = cost[begin] + score
                    last[end] = begin

    def _emit(self, text: str, out: list[int]) -> None:
        k = self.ids.get(text)
        if k is not None:
            out.append(k)
        elif self.bytes:
            out += [self.bytes[b] for b in text.encode()]
        else:
            out.append(self.unknown)

    def search(self, text: str, window: int | None = None) -> Iterator[list[int]]:
        """Yield ids as they are decided. ``window``: boundaries kept before looking for a meeting point.

        Near its beginning a text's backpointers depend on its first characters alone, which many texts share: within the longest
        piece's length they are remembered, and worked out where a path or a candidate piece needs them.
        """
        window = max(window or 4 * self.longest, 2)
        least, size = window, len(text)
        cost: dict[int, float] = {0: 0.0}
        start, left = 0, ""
        if len(self._backpointers) >= CACHE_ENTRIES:
            self._backpointers.clear()
        last: dict[int, int] = {0: 0}
        shared = min(self.longest, window - 1, size) if self.bpe else 0
        end = shared
        while start < size:
            stop = min(size, start + window)
            if end < stop:
                self._extend(text, start, end + 1, stop, left, last, cost)
            end = stop
            if end == size:
                meet = end
            else:
                fronts = set(range(max(start, end - self.longest + 1), end + 1))
                while len(fronts) > 1:  # step back from the farthest until all paths are in one boundary
                    far = max(fronts)
                    fronts.discard(far)
                    fronts.add((last[far] if far in last else self._shared(text[:far])) if far > start else start)
                meet = fronts.pop()
            if meet == start:
                window = 2 * (end - start)  # no meeting point yet: look again after as much text
                continue
            path, at = [], meet
            while at > start:
                begin = last[at] if at in last else self._shared(text[:at])
                path.append(text[begin:at])
                at = begin
            ids: list[int] = []
            for piece in reversed(path):
                k = self.ids.get(piece)
                if k is None:
                    self._emit(piece, ids)
                else:
                    ids.append(k)
            yield ids
            if meet == size:
                return
            # The boundary that was met keeps its last piece: it is the next piece's neighbour.
            floor, keep = cost.get(meet, 0.0), meet - len(path[0])
            last = {at: last[at] if at in last else self._shared(text[:at]) for at in range(meet, end + 1)}
            cost = {at: c - floor for at, c in cost.items() if at >= meet}
            start, left, window = meet, text[keep:meet], least

    def _encode_marked(self, text: str) -> list[int]:
        """Ids of a text whose spaces are marks, part by part between certain boundaries."""
        out: list[int] = []
        for chunk in self._split(text):
            for ids in self.search(chunk):
                out += ids
        return out

    def encode_bytes(self, text: str) -> bytes:
        """The ids of a text, as the library gives them, as native 32-bit integers; empty text: none.

        Where no two spaces meet, paths have a boundary before each space and around each line feed, so the text is a sequence of
        words, most of which have been seen before.
        """
        if not text:
            return b""
        words = text.replace("\n", " \n").split(" ") if self.cut_at_lines and self.cut_at_marks and self.prefix and SPACE not in text else [""]
        if "" in words:
            marked = text.replace(" ", SPACE)
            return array("i", self._encode_marked(SPACE + marked if self.prefix else marked)).tobytes()
        parts = list(map(self._words.get, words))
        if None in parts:
            for i, known in enumerate(parts):
                if known is None:
                    parts[i] = self._new_word(words[i])
        return b"".join(parts)

    def _new_word(self, word: str) -> bytes:
        known = self._words.get(word) or self._older.get(word)
        if known is None:
            known = array("i", self._encode_marked(word if word[0] == "\n" else SPACE + word)).tobytes()
        if len(word) <= 64:
            if len(self._words) >= CACHE_ENTRIES:  # the words seen since the last time stay within reach
                self._older, self._words = self._words, {}
            self._words[word] = known
        return known

    def forget(self) -> None:
        """Empty the caches: a worker keeps the model for its next task, but not its words through other stages."""
        for cache in (self._words, self._older, self._backpointers, self._stable):
            cache.clear()

    def encode(self, text: str) -> list[int]:
        return array("i", self.encode_bytes(text)).tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces joined, byte pieces read as UTF-8 (invalid ones as U+FFFD), marks turned into spaces."""
        table = self._decoded
        text = b"".join([table[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


_loaded: dict[str, Model] = {}


def load(path: str) -> Model:
    """The model of a file, read once in each worker."""
    if path not in _loaded:
        with open(path, "rb") as f:
            _loaded[path] = Model(f.read())
    return _loaded[path]


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids, n_tokens, decoded_sha256 and round_trip of every text.

    ``decoded_sha256`` is of the text decoded from the ids, ``round_trip`` whether that is the text again (true but for texts that
    hold the mark U+2581 itself, which decode to a space). Null and empty texts have no ids; a text of any length is
    encoded in a bounded window. Repeated rows keep a row each, an empty table gives an empty one, and other columns are not looked
    at, whatever their names. The model file must be present on every executor at ``model_path``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                ids, digests, same = [], [], []
                for text in batch.column(1).slice(start, 64).to_pylist():
                    got = model.encode_bytes(text or "")
                    back = model.decode(array("i", got).tolist())
                    ids.append(got)
                    digests.append(hashlib.sha256(back.encode()).hexdigest())
                    same.append(back == (text or ""))
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32)))
                columns = [batch.column(0).slice(start, 64), lists, pa.array(np.diff(ends), pa.int64()), pa.array(digests), pa.array(same)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "n_tokens", "decoded_sha256", "round_trip"])
        model.forget()

    schema = "doc_id long, ids array<int>, n_tokens long, decoded_sha256 string, round_trip boolean"
    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, schema)
