"""SentencePiece encoding by a streaming Viterbi search, and decoding."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from tarmac.llm.common import FORGET, map_rows, pick

SPACE = "▁"
#: What a character without a piece costs more than the rarest piece; it is written as its bytes.
UNKNOWN_PENALTY = 10.0
#: A task remembers the ids of so many words, none longer than 64 characters, then begins anew.
REMEMBERED = 150_000
CHUNK = 4096
#: Words of no more characters are searched in step.
SHORT = 24


class Pieces:
    """Pieces of a model with byte fallback, each with a log probability.

    A model of merges gives ranks instead of probabilities; a piece of rank r then has probability 1 / (r + 2) over their
    sum. A model of probabilities keeps its own.
    """

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        scores = {i: model.get_score(i) for i in plain}
        if all(s == int(s) for s in scores.values()):
            total = math.log(sum(1 / (2 - s) for s in scores.values()))
            scores = {i: -math.log(2 - s) - total for i, s in scores.items()}
        self.byte = {int(names[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.scores = scores
        self.pieces = {names[i].replace(SPACE, " "): (scores[i], (i,)) for i in plain}
        self.longest = max(map(len, self.pieces))
        # beginnings of pieces lead on, other strings end the search at their place
        begun = {p[:n] for p in self.pieces for n in range(1, len(p))}
        self.lookup = {p: None for p in begun} | self.pieces
        self.unknown = min(scores.values()) - UNKNOWN_PENALTY
        self.bytes_of = [b""] * size
        for i in plain:
            self.bytes_of[i] = names[i].replace(SPACE, " ").encode()
        for value, i in self.byte.items():
            self.bytes_of[i] = bytes([value])
        # where no piece has a space behind another character, every path has a boundary before each word
        self.by_word = not any(re.search(r"[^ ] ", p) for p in self.pieces)
        self._plant()
        self.known: dict[str, bytes] = {}

    def _plant(self) -> None:
        """The pieces as a tree over bytes: node 0 is the root, 0 as a child means none. Nodes with children come first; all
        others share the last row, which has none."""
        child: dict[int, int] = {}
        at_piece: dict[int, int] = {}
        for name, (_, ids) in self.pieces.items():
            node = 0
            for b in name.encode():
                node = child.setdefault(node << 8 | b, len(child) + 1)
            at_piece[node] = ids[0]
        size = len(child) + 1
        edges = np.fromiter(child.keys(), dtype=np.int64, count=len(child))
        parents = np.zeros(size, dtype=bool)
        parents[edges >> 8] = True
        number = np.empty(size, dtype=np.int64)
        number[np.argsort(~parents, kind="stable")] = np.arange(size)
        self.leaf = int(parents.sum())
        self.next = np.zeros((self.leaf + 1, 256), dtype=np.min_scalar_type(size))
        self.next[number[edges >> 8], edges & 255] = number[np.arange(1, size)]
        self.piece_at = np.zeros(size, dtype=np.int32)
        self.score_at = np.full(size, -np.inf)
        for node, i in at_piece.items():
            self.piece_at[number[node]], self.score_at[number[node]] = i, self.scores[i]

    def stream(self, chunks: Iterable[str]) -> Iterator[list[int]]:
        """Ids of a text that comes in chunks, by the most probable cut; ties go to the longer last piece.

        The window holds the characters behind the last boundary on which all surviving paths agree. Paths survive that
        end within the longest piece of the place reached; ids before their meeting point are given out and forgotten.
        """
        chunks = iter(chunks)
        lookup, longest = self.lookup, self.longest
        window, at, look, more = "", 0, 2 * longest, True
        best: list[float] = [0.0]
        back: list[tuple[int, tuple[int, ...]]] = [(0, ())]
        while True:
            while more and len(window) - at < longest:
                chunk = next(chunks, None)
                more = chunk is not None
                window += chunk or ""
            ahead = min(longest, len(window) - at)
            if not ahead:
                break
            short = at + ahead + 1 - len(best)
            if short > 0:
                best += [-math.inf] * short
                back += [(0, ())] * short
            here = best[at]
            end = at
            while end < at + ahead:
                end += 1
                found = lookup.get(window[at:end], False)
                if found:
                    score = here + found[0]
                    if score > best[end]:
                        best[end] = score
                        back[end] = (at, found[1])
                elif found is False:
                    break
            if best[at + 1] == -math.inf or (here + self.unknown > best[at + 1] and window[at] not in self.pieces):
                best[at + 1] = here + self.unknown
                back[at + 1] = (at, tuple(self.byte[b] for b in window[at].encode()))
            at += 1
            if at >= look:
                meet = self._meeting(best, back, at)
                if meet:
                    yield self._path(back, meet)
                    window, at = window[meet:], at - meet
                    best = best[meet:]
                    back = [(max(0, b - meet), ids) for b, ids in back[meet:]]
                look = at + longest
        yield self._path(back, at)

    @staticmethod
    def _meeting(best: list[float], back: list[tuple[int, tuple[int, ...]]], at: int) -> int:
        """The last boundary that the paths to all open places share."""
        places = {p for p in range(at, len(best)) if best[p] > -math.inf}
        while len(places) > 1:
            last = max(places)
            places.remove(last)
            places.add(back[last][0])
        return min(places)

    @staticmethod
    def _path(back: list[tuple[int, tuple[int, ...]]], at: int) -> list[int]:
        parts = []
        while at > 0:
            at, ids = back[at]
            parts.append(ids)
        return [i for ids in reversed(parts) for i in ids]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts, with the customary space before each.

        All paths meet before each word, so words are searched one by one and remembered: short ones in step with all
        others of the batch, long ones by the stream.
        """
        if not self.by_word:
            return [self._streamed(" " + text) for text in texts]
        known, cut = self.known, [_WORDS.findall(" " + text) for text in texts]
        if len(known) > REMEMBERED:
            known.clear()
        new = {w for words in cut for w in words}.difference(known)
        short = [w for w in new if len(w) <= SHORT]
        for start in range(0, len(short), 8_000):
            self._in_step(short[start : start + 8_000])
        for word in new.difference(known):
            known[word] = self._streamed(word).tobytes()
        ids = [np.frombuffer(b"".join(map(known.__getitem__, words)), dtype=np.int32) for words in cut]
        for word in new:
            if len(word) > 64:
                del known[word]
        return ids

    def _streamed(self, text: str) -> np.ndarray:
        return np.array([i for part in self.stream(_chunks(text)) for i in part], dtype=np.int32)

    def _in_step(self, words: list[str]) -> None:
        """Search many short words at once: place by place, all pieces that begin there. Scores are added in the same
        order as in the stream, so that ties go the same way. Words with characters that no piece has are left out."""
        if not words:
            return
        data = [w.encode() for w in words]
        lengths = np.array([len(d) for d in data])
        width = int(lengths.max())
        text = np.frombuffer(b"".join(d.ljust(width, b"\0") for d in data), dtype=np.uint8).reshape(len(words), width)
        best = np.full((len(words), width + 1), -np.inf)
        best[:, 0] = 0.0
        came = np.zeros((len(words), width + 1), dtype=np.int32)
        piece = np.zeros((len(words), width + 1), dtype=np.int32)
        for at in range(width):
            who = np.flatnonzero((lengths > at) & (best[:, at] > -np.inf))
            node = np.zeros(len(who), dtype=self.next.dtype)
            for end in range(at + 1, width + 1):
                node = self.next[np.minimum(node, self.leaf), text[who, end - 1]]
                on = (node > 0) & (lengths[who] >= end)
                who, node = who[on], node[on]
                if not len(who):
                    break
                found = self.piece_at[node]
                score = best[who, at] + self.score_at[node]
                better = score > best[who, end]
                w = who[better]
                best[w, end], came[w, end], piece[w, end] = score[better], at, found[better]
        rows = np.arange(len(words))
        whole = best[rows, lengths] > -np.inf
        marked = np.full((len(words), width + 1), -1, dtype=np.int32)
        rows, places = rows[whole], lengths[whole].copy()
        while len(rows):
            marked[rows, places] = piece[rows, places]
            places = came[rows, places]
            rows, places = rows[places > 0], places[places > 0]
        on = marked >= 0
        ids, ends = marked[on].tobytes(), 4 * np.cumsum(on.sum(axis=1))
        begin = 0
        for word, good, end in zip(words, whole.tolist(), ends.tolist()):
            if good:
                self.known[word] = ids[begin:end]
            begin = end

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")[1:]


_WORDS = re.compile(r"\x20*[^\x20]+|\x20+")
_MODELS: dict[str, Pieces] = {}
#: The models that the task which now runs has asked for.
_ASKED: set[str] = set()


def _forget() -> None:
    """At the end of a task: words are forgotten, and the models that it did not ask for, since their stage is over."""
    for path in _MODELS.keys() - _ASKED:
        del _MODELS[path]
    for kept in _MODELS.values():
        kept.known.clear()
    _ASKED.clear()


FORGET.append(_forget)


def _chunks(text: str) -> Iterator[str]:
    return (text[i : i + CHUNK] for i in range(0, len(text), CHUNK))


def model(path: str) -> Pieces:
    """One model for a worker process and file, kept from task to task of a stage."""
    _ASKED.add(path)
    if path not in _MODELS:
        _MODELS[path] = Pieces(path)
    return _MODELS[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, n_ids, round_trip) of every document for the model at ``path``, which lies on every executor.

    ``round_trip`` tells whether decoding the ids gives the text again, character by character.

    Null text: null ids, no count, no round trip. Empty text: the space before it is its only piece. Null doc_id and
    repeated rows: rows of their own. Empty table: empty result. Other columns are left out.
    """
    rows = pick(docs, "doc_id", "text")

    def run(batch: dict[str, list]) -> dict[str, list]:
        pieces = model(path)
        made = iter(pieces.encode([t for t in batch["text"] if t is not None]))
        ids = [None if t is None else next(made) for t in batch["text"]]
        same = [i is None or pieces.decode(i.tolist()) == t for i, t in zip(ids, batch["text"])]
        return {"ids": _lists(ids), "n_ids": [0 if i is None else len(i) for i in ids], "round_trip": [None if i is None else s for i, s in zip(ids, same)]}

    return map_rows(rows, run, "ids array<int>, n_ids int, round_trip boolean", ("doc_id",))


def _lists(ids: list[np.ndarray | None]) -> pa.Array:
    flat = np.concatenate([i for i in ids if i is not None] or [np.zeros(0, dtype=np.int32)])
    ends = np.cumsum([0 if i is None else len(i) for i in ids], dtype=np.int64)
    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32), mask=np.array([i is None for i in ids] + [False]))
    return pa.ListArray.from_arrays(offsets, pa.array(flat.astype(np.int32)))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids). Null ids give a null text; ids that the model lacks fail."""

    def run(batch: dict[str, list]) -> dict[str, list]:
        return {"text": [None if ids is None else model(path).decode(ids) for ids in batch["ids"]]}

    return map_rows(encoded.select("doc_id", "ids"), run, "text string", ("doc_id",))
