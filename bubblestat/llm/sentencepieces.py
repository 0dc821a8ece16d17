"""SentencePiece ids of whole texts, by the last token of each prefix, and texts from ids."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Segments whose ids one worker process keeps, twice: beyond, those that are used again move on and the others are dropped. No longer ones than LONGEST are kept.
KEPT, LONGEST = 500_000, 64
SPACE = "▁"


def _connected(pieces: Iterable[str]) -> list[set[str]]:
    """The letters of pieces, in sets of those that stand side by side and of all that these connect."""
    sets: dict[str, set[str]] = {}
    for p in pieces:
        sets.update((a, {a}) for a in p if a not in sets)
        for a, b in zip(p, p[1:], strict=False):
            x, y = sets[a], sets[b]
            if x is not y:
                x |= y
                sets.update(dict.fromkeys(y, x))
    return list({id(k): k for k in sets.values()}.values())


class PrefixTable:
    """Encodes as a SentencePiece BPE model does, without merging texts.

    Merging joins the adjacent pair of best score, the leftmost among equals, for as long as any pair is a piece. A run of the resulting tokens is the encoding
    of what it spells, and tokens in a row are an encoding if each is that of its own letters and each two neighbours stay apart when merged
    alone. So each prefix of a text has one last token: the one that matches at its end, and stays apart from the last token of the prefix before it. All
    matches come from one pass of an automaton. The table of last tokens, read backwards, is the encoding.

    Texts fall apart where no piece spans: before a mark of space that follows something else, and between kinds of letters that no piece connects, such as words and points.
    Distinct segments are kept while they are used.

    Letters that are no piece become their bytes' pieces, or the unknown id in a model without. Models of another type, with unused pieces, symbols of the user, or a
    normalizer other than the identity with a leading space raise ValueError.
    """

    _made: dict[str, PrefixTable] = {}

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        self.library = SentencePieceProcessor(model_file=path)
        told = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            told.ParseFromString(file.read())
        norm, kinds = told.normalizer_spec, told.SentencePiece
        if told.trainer_spec.model_type != told.trainer_spec.BPE or told.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError(f"{path} is no BPE model with leading marks of space")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces:
            raise ValueError(f"{path} changes texts before it encodes them")
        if any(p.type in (kinds.UNUSED, kinds.USER_DEFINED) for p in told.pieces):
            raise ValueError(f"{path} has unused pieces or symbols of the user")
        self.end = self.library.eos_id()
        self.ids = {p.piece: i for i, p in enumerate(told.pieces) if p.type == kinds.NORMAL}
        self.score = {p.piece: p.score for p in told.pieces if p.type == kinds.NORMAL}
        byte = {p.piece: i for i, p in enumerate(told.pieces) if p.type == kinds.BYTE}
        self.bytes = [byte[f"<0x{b:02X}>"] for b in range(256)] if byte else None
        self.unknown = self.library.unk_id()
        long = [p for p in self.ids if len(p) > 1]
        inner = any(SPACE in p.lstrip(SPACE) for p in long)  # a piece that goes on after a space: texts are one segment then
        kinds_of_letters = "".join(f"{SPACE}*[{re.escape(''.join(sorted(k)))}]+|" for k in _connected(p.lstrip(SPACE) for p in long))
        self.cut = re.compile("(?s:.+)" if inner else f"(?s:{kinds_of_letters}{SPACE}+|.)").findall
        self.matches = ahocorasick.Automaton()
        for p in self.ids:
            self.matches.add_word(p, (p, len(p), {}))
        self.matches.make_automaton()
        self.history: dict[str, list[tuple[float, str, str]] | None] = {}
        self.pairs = 0
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> PrefixTable:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def merges(self, piece: str) -> list[tuple[float, str, str]] | None:
        """(score, token then first, token then last) of each merge that makes a piece out of its letters; None if merging makes something else of them."""
        if piece not in self.history:
            parts, done = list(piece), []
            while True:
                scores = [self.score.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
                best = max((s for s in scores if s is not None), default=None)
                if best is None:
                    break
                i = scores.index(best)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                done.append((best, parts[0], parts[-1]))
            self.history[piece] = done if len(parts) == 1 else None
        return self.history[piece]

    def stays_apart(self, a: str, b: str) -> bool:
        """Whether merging the letters of two tokens in a row ends with these two: at no time is the pair at their border the best, or equal to b's best. With no a: whether b's become b."""
        left, right = self.merges(a) if a else [], self.merges(b)
        if left is None or right is None or not a:
            return left is not None and right is not None
        i = j = 0
        last, first = a[-1], b[0]
        none = float("-inf")
        while True:
            x = left[i][0] if i < len(left) else none
            y = right[j][0] if j < len(right) else none
            border = self.score.get(last + first)
            if border is not None and border > x and border >= y:
                return False
            if i == len(left) and j == len(right):
                return True
            if x >= y and i < len(left):  # equal scores: the left one first
                last, i = left[i][2], i + 1
            else:
                first, j = right[j][1], j + 1

    def tokens(self, text: str) -> list[str]:
        """The tokens of a text whose spaces are marked; a letter that is no piece is a token of its own."""
        last, done = [""] * (len(text) + 1), 0  # prefixes up to `done` have their last tokens
        for stop, (piece, size, apart) in self.matches.iter(text):
            if stop < done:
                continue
            while done < stop:  # no piece ends there
                done += 1
                last[done] = text[done - 1]
            before = last[stop + 1 - size]
            fits = apart.get(before)
            if fits is None:
                fits = apart[before] = self._judged(before, piece)
            if fits:
                done = stop + 1
                last[done] = piece
        for end in range(done + 1, len(text) + 1):
            last[end] = text[end - 1]
        out, at = [], len(text)
        while at:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def _judged(self, a: str, b: str) -> bool:
        self.pairs += 1
        if self.pairs > 12 * KEPT:  # letters that are no piece are without bound
            self.pairs = 0
            for _, _, apart in self.matches.values():
                apart.clear()
        return self.stays_apart(a, b)

    def _ids(self, segment: str) -> bytes:
        out: list[int] = []
        for t in self.tokens(segment):
            if t in self.ids:
                out.append(self.ids[t])
            else:
                out += [self.bytes[b] for b in t.encode()] if self.bytes else [self.unknown]
        return np.array(out, "<i4").tobytes()

    def encode(self, text: str, end: bool = True) -> bytes:
        """Ids as little-endian 32-bit integers. A text gets a leading space; an empty one has none."""
        segments = self.cut(SPACE + text.replace(" ", SPACE)) if text else []
        if len(self.known) > KEPT:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        new, own = set(segments).difference(known), {}
        for s in new:
            (known if len(s) <= LONGEST else own)[s] = older.get(s) or self._ids(s)
        ids = b"".join([known[s] if s in known else own[s] for s in segments] if own else map(known.__getitem__, segments))
        return ids + np.array([self.end], "<i4").tobytes() if end else ids


def _ids(table: PrefixTable, texts: pa.Array, end: bool) -> pa.Array:
    each = [table.encode(t.as_py() or "", end) for t in texts]
    ends = np.cumsum([0, *map(len, each)]) // 4
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(each), "<i4")))


def _texts(table: PrefixTable, lists: pa.Array) -> pa.Array:
    return pa.array((table.library.decode(x.values.to_numpy().tolist()) if x.is_valid and len(x) else "" for x in lists), pa.string())


def encoded(docs: DataFrame, model: str, end: bool = True, back: bool = False) -> DataFrame:
    """(row, ids): each row of docs, whole, with the ids of its text as array of int; with `end` the end id follows; with `back` text_back holds what decoded() makes of the ids, in the same pass.

    Ids equal encode(text, add_eos=end) of the library. Null and empty texts have the end id alone, or none. Very long texts take time in proportion to their
    letters, and memory of a few times their bytes in one task: a text is one value. Repeated rows, null ids and any other columns stay as they are. Empty table: no rows.
    Nothing is shuffled. model: a path that every executor has."""

    @F.arrow_udf("ids array<int>, text_back string" if back else "ids array<int>")
    def coded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = PrefixTable.of(model)
        for texts in batches:
            ids = _ids(table, texts, end)
            yield pa.StructArray.from_arrays([ids, _texts(table, ids)], ["ids", "text_back"]) if back else pa.StructArray.from_arrays([ids], ["ids"])

    return docs.select(F.struct("*").alias("row"), coded(F.col("text").cast("string")).alias("c")).select("row", "c.*")


def decoded(rows: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """rows with text_back: what the library's decode makes of their ids. Null and empty lists give the empty text; ids that the model doesn't have raise."""

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            yield _texts(PrefixTable.of(model), lists)

    return rows.withColumn("text_back", text(F.col(ids)))
