"""SentencePiece encoding and decoding by streaming Viterbi."""

from __future__ import annotations

import functools
import itertools
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Words whose ids a worker remembers.
WORDS = 400_000
#: Pairs of pieces that a worker remembers the verdict on.
JOINTS = 300_000
#: Rows that a worker makes at a time.
ROWS = 512


class Shown:
    """What each id of a model file stands for: bytes of its text, or the byte that it is a part of."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = model.id_to_piece(list(range(model.get_piece_size())))
        self.value_of = {i: bytes([int(name[3:-1], 16)]) for i, name in enumerate(names) if model.is_byte(i)}
        self.shown = [b"" if model.is_control(i) else None if model.is_byte(i) else " \u2047 ".encode() if model.is_unknown(i) else name.replace(SPACE, " ").encode() for i, name in enumerate(names)]


class Vocabulary(Shown):
    """Pieces of a model file: scores and ids by piece, bytes, what each id stands for, and which pieces can stand side by side."""

    def __init__(self, path: str):
        super().__init__(path)
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.names = model.id_to_piece(list(range(n)))
        self.unknown = model.unk_id()
        self.bytes = {b[0]: i for i, b in self.value_of.items()}
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i) for i in range(n)]
        self.scores = {self.names[i]: model.get_score(i) for i in range(n) if not special[i]}
        #: Pieces that merging makes of their own text; no others occur.
        self.pieces = {p: i for i, p in enumerate(self.names) if p in self.scores and (len(p) == 1 or self.merged(p) == [p])}
        self.longest = max(map(len, self.pieces), default=1)
        #: Where a space sign is inside no piece but runs of them, no piece crosses from another character to a space sign.
        self.splits_at_spaces = not any(SPACE in p[1:] and p.strip(SPACE) for p in self.pieces)
        #: Two characters that stand side by side in a piece; between others there is a boundary in any case.
        self.pairs = {p[i : i + 2] for p in self.scores for i in range(len(p) - 1)}
        #: Finds all pieces in a stream, by their ends.
        self.automaton = ahocorasick.Automaton()
        for p, i in self.pieces.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.joints: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """What the merge rules make of a short text: the neighbours whose union scores best become one, the leftmost of equal ones first."""
        parts, scores = list(text), self.scores
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def joint(self, left: int, right: int) -> bool:
        """Whether the merge rules leave the boundary between two pieces alone, by their ids."""
        found = self.joints.get(left << 32 | right)
        if found is None:
            if len(self.joints) >= JOINTS:
                self.joints.clear()
            a, b = self.names[left], self.names[right]
            found = self.joints[left << 32 | right] = a[-1] + b[0] not in self.pairs or self.merged(a + b) == [a, b]
        return found

    def ids_of_unknown(self, char: str) -> list[int]:
        if len(self.bytes) == 256:
            return [self.bytes[b] for b in char.encode()]
        return [self.unknown]

    def ids(self, part: str) -> list[int]:
        found = self.pieces.get(part)
        return [found] if found is not None else self.ids_of_unknown(part)


class Open:
    """The window of a stream: its open positions, each with the one path that survives there.

    A path is a sequence of pieces (or single unknown characters) up to a position; it survives if the merge rules leave every boundary
    in it alone. Exactly one path survives at each position: what the rules make of the text up to there. So the last one is
    their result for the whole text. Pieces that end at a position come from an automaton over the vocabulary, the longest first.
    Only the last vocabulary.longest positions can be the start of an unseen piece; where the backpointers of all of these meet, the ids up
    to there are certain, are given out and are forgotten.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        # by position from base on: the id of the path's last piece (-1: none in the vocabulary), its start, the character before
        self.base, self.last, self.start, self.chars = 0, [-1], [0], ""

    def feed(self, chunk: str) -> None:
        last, start, base, joints, joint = self.last, self.start, self.base, self.vocabulary.joints, self.vocabulary.joint
        # pieces that end in the chunk may start in the characters before it
        seen = max(0, len(self.chars) - self.vocabulary.longest + 1)
        self.chars += chunk
        text = self.chars[seen:]
        size, settled, shift = len(last), True, seen + 1
        for at, (piece, n) in self.vocabulary.automaton.iter(text):
            end = at + shift
            if end >= size:
                while size <= end:
                    last.append(-1)
                    start.append(base + size - 1)
                    size += 1
                settled = False
            if settled:
                continue
            if n > 1:
                before = last[end - n]
                if before >= 0:
                    verdict = joints.get(before << 32 | piece)
                    if not (joint(before, piece) if verdict is None else verdict):
                        continue
                start[end] = base + end - n
            last[end] = piece
            settled = True
        for size in range(size, len(self.chars) + 1):
            last.append(-1)
            start.append(base + size - 1)

    def ids(self, to: int) -> list[int]:
        """Ids of the path up to a position."""
        out, last, start, base, at = [], self.last, self.start, self.base, to
        while at > base:
            piece = last[at - base]
            if piece >= 0:
                out.append(piece)
            else:
                out += reversed(self.vocabulary.ids_of_unknown(self.chars[at - base - 1]))
            at = start[at - base]
        out.reverse()
        return out

    def commit(self) -> list[int]:
        """The ids on which all open positions agree, which then leave the window."""
        base, end = self.base, self.base + len(self.chars)
        ends = set(range(max(base, end - self.vocabulary.longest + 1), end + 1))
        while len(ends) > 1:
            ends.remove(latest := max(ends))
            ends.add(self.start[latest - base] if latest > base else base)
        meet = ends.pop()
        out, gone = self.ids(meet), meet - base
        if gone > 0:
            self.last, self.start, self.chars, self.base = self.last[gone:], self.start[gone:], self.chars[gone:], meet
        return out


def viterbi(chars: Iterable[str], vocabulary: Vocabulary) -> Iterator[list[int]]:
    """Ids of a stream of characters, given out as soon as they are certain (see Open); at the stream's end, the rest.

    The window takes in 2 * vocabulary.longest characters at a time.
    """
    window, stream, most = Open(vocabulary), iter(chars), 2 * vocabulary.longest
    while chunk := "".join(itertools.islice(stream, most)):
        window.feed(chunk)
        if len(chunk) == most and (found := window.commit()):
            yield found
    if found := window.ids(window.base + len(window.chars)):
        yield found


def within_window(run: str, vocabulary: Vocabulary) -> list[int]:
    """All ids that viterbi() gives for a run; one that the window takes in at once commits at its end."""
    if len(run) > 2 * vocabulary.longest:
        return [i for part in viterbi(run, vocabulary) for i in part]
    window = Open(vocabulary)
    window.feed(run)
    return window.ids(len(run))


def _runs_of(text: str) -> Iterator[str]:
    """text in runs that start with space signs and hold none after another character."""
    start, n = 0, len(text)
    while start < n:
        at = start
        while at < n and text[at] == SPACE:
            at += 1
        cut = text.find(SPACE, at)
        cut = n if cut < 0 else cut
        yield text[start:cut]
        start = cut


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> tuple[Vocabulary, Callable[[str], bytes]]:
    """The vocabulary, and a function from a text to its ids, four bytes each, little-endian."""
    vocabulary = Vocabulary(path)
    known: dict[str, bytes] = {}

    def ids(run: str) -> bytes:
        return struct.pack(f"<{len(found := within_window(run, vocabulary))}I", *found)

    pairs, line_end = vocabulary.pairs, np.array(vocabulary.ids("\n"), "<u4").tobytes()

    def word(run: str) -> bytes:
        found = known.get(run)
        if found is None:
            plain = run[1:]
            cuts = [] if plain.isascii() and plain.isalpha() else [i for i in range(1, len(run)) if run[i - 1 : i + 1] not in pairs]
            found = b"".join([word(run[a:b]) for a, b in zip([0, *cuts], [*cuts, len(run)])]) if cuts else ids(run)
            if len(run) <= 64:
                if len(known) >= WORDS:
                    # the older half goes; words in use come back at their next miss
                    for w in list(itertools.islice(known, WORDS // 2)):
                        del known[w]
                known[run] = found
        return found

    def line(text: str) -> bytes:
        if SPACE + SPACE in text:
            return b"".join(map(word, _runs_of(text)))
        parts = text.split(SPACE)
        runs = [SPACE + p for p in parts]
        runs[0] = parts[0]
        return b"".join([known[w] if w in known else word(w) for w in runs])

    known[""] = b""

    def encode(text: str) -> bytes:
        if not text:
            return b""
        text = SPACE + text.replace(" ", SPACE)
        if not vocabulary.splits_at_spaces:
            return ids(text)
        if splits_at_lines:
            return line_end.join([line(part) for part in text.split("\n")])
        return line(text)

    splits_at_lines = not any("\n" in p for p in vocabulary.scores)
    return vocabulary, encode


@functools.lru_cache(maxsize=2)
def shown(path: str) -> Shown:
    return Shown(path)


def decode_ids(ids: np.ndarray, vocabulary: Shown) -> str:
    """The text of ids; the space that encoding puts first is taken off, and bytes that aren't UTF-8 become replacement signs."""
    stands, value_of = vocabulary.shown, vocabulary.value_of
    text = b"".join([stands[i] if stands[i] is not None else value_of[i] for i in ids.tolist()]).decode("utf-8", "replace")
    return text[1:] if text[:1] == " " else text


def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of ROWS rows, so that few texts and ids are held at once."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def encode_texts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): ids of each whole text, as binary of four bytes each, little-endian.

    Ids are those of the file's merge rules, as its own library gives them; a space sign stands for each space and is
    put before the text, unknown characters become bytes. Null and empty texts
    have no ids. Repeated rows have equal ids. Other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, encode = encoder(model)
        for b in small(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([encode(t or "") for t in b.column(1).to_pylist()], pa.binary())], ["doc_id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, ids binary")


def decode_texts(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids, text): encoded with the texts of its ids; null ids are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shown(model)
        for b in small(batches):
            texts = [decode_ids(np.frombuffer(x or b"", "<u4"), vocabulary) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids binary, text string")
