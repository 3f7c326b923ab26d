"""SentencePiece merge-type (BPE) encoding by backtracking, and decoding.

A sequence of pieces is the encoding of a text exactly if re-merging every two
neighbours gives the same two pieces again. So the encoder walks left to right over
the Aho-Corasick matches of all pieces, longest first, keeps only compatible
neighbours, and steps back over positions that a bit field marks as dead ends.

No piece holds a space mark after another character, and a character outside the
vocabulary never merges; texts are therefore cut before such runs of space marks and
around line feeds (where the model has no line feed). Each distinct cut of a batch is
encoded once: one pass of the automaton finds the matches of all of them. What a worker
keeps between batches (cuts and checked neighbours) is bounded by bytes.

Defined cases: null and empty texts give no pieces (only the end id, if asked for);
null ids are kept; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from dendra.llm.common import held, lean, small_batches

MARK = "▁"
#: Bytes of the two generations of a worker's memo, and its checked neighbours; they bound memory, not results.
MEMO_BYTES = 48 << 20
PAIR_BITS = 20
ENTRY_BYTES = 300  # of a memo entry, beside its strings
#: Texts that leave a worker together, in characters.
PART = 1 << 20
#: Fewer cuts than these are walked one by one.
FEW = 24
#: Lengths of pieces are kept in so many bits.
LENGTH_BITS = 16


class Pieces:
    """Vocabulary of a merge-type model: scores order the merges, higher first."""

    def __init__(self, model: bytes):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.control = {i for i in range(len(self.names)) if sp.is_control(i)}
        self.unknown = {i for i in range(len(self.names)) if sp.is_unknown(i)}
        self.byte_of = {i: int(self.names[i][3:5], 16) for i in range(len(self.names)) if sp.is_byte(i)}
        self.byte_ids = {b: i for i, b in self.byte_of.items()}
        special = self.control | self.unknown | set(self.byte_of)
        self.ids = {p: i for i, p in enumerate(self.names) if i not in special}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        letters = set().union(*self.ids) if self.ids else set()
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece holds a space mark after another character; texts can't be cut at spaces")
        if not letters <= set(self.ids):
            raise ValueError("a character of a piece is no piece itself; it might merge although it is outside the vocabulary")
        self.cut_lines = "\n" not in letters
        self.pattern = re.compile(" *[^ \n]+|\n| +" if self.cut_lines else " *[^ ]+| +")
        self.gap = next(c for c in map(chr, chain([10], range(0xE000, 0x10FFFF))) if c not in letters)  # no piece reaches over it
        # a character that is no piece stands alone; so does one below, as the piece after all others
        self.alone = len(self.names)
        self.size = np.array([*map(len, self.names), 1])
        #: The longest shorter piece that begins a piece; -1: none.
        self.shorter = np.array([next((self.ids[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in self.ids), -1) if p in self.ids else -1 for p in self.names] + [-1])
        self.single = np.full(0x110000, self.alone, np.int32)
        for c in letters:
            self.single[ord(c)] = self.ids[c]
        self.surface = [p.replace(MARK, " ") for p in self.names]
        # neighbours checked so far, with the verdict in the lowest bit: a newer pair takes the place of an older one
        self.pairs = np.full(1 << PAIR_BITS, -1, np.int64)
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if len(p) > 1:
                self.automaton.add_word(p, i << LENGTH_BITS | len(p))
        if len(self.automaton):
            self.automaton.make_automaton()

    def merge(self, text: str) -> list[str]:
        """The definition: join the neighbours with the best score, leftmost first, until none joins."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def remerges(self, left: int, right: int) -> bool:
        """Whether re-merging the two neighbours gives them back. Nothing merges with what stands alone, so that is as good as no left neighbour."""
        if right == self.alone:
            return True
        names = [self.names[i] for i in (left, right) if i != self.alone]
        return self.merge("".join(names)) == names

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """remerges() of many neighbours, from the table where it holds them."""
        key = left * (self.alone + 1) + right
        slot = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PAIR_BITS)).view(np.int64)
        out = self.pairs[slot]
        new = np.flatnonzero(out >> 1 != key)
        if len(new):
            fresh, back = np.unique(key[new], return_inverse=True)
            found = np.array([k << 1 | self.remerges(*divmod(k, self.alone + 1)) for k in fresh.tolist()])
            out[new] = self.pairs[slot[new]] = found[back]
        return (out & 1).astype(bool)

    def longest(self, text: str) -> np.ndarray:
        """By position the longest piece that begins there, from one pass over the text."""
        out = self.single[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        if len(self.automaton):
            found = np.fromiter(chain.from_iterable(self.automaton.iter(text)), np.int64).reshape(-1, 2)
            # matches come by their ends, so a start's last match is its longest
            out[found[:, 0] - (found[:, 1] & (1 << LENGTH_BITS) - 1) + 1] = found[:, 1] >> LENGTH_BITS
        return out

    def backtrack(self, longest: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """By position the chosen piece, -1 inside pieces, for cuts (begin, end) of one text; all of them go a step at a time.

        A cut stands at a position and tries a candidate: taken if no bit marks its end as failed and it is compatible with the
        piece before; else the next shorter one. With none left the position's bit is set and the piece before it is shortened."""
        size, shorter, alone = self.size, self.shorter, self.alone
        longest = np.append(longest, -1)
        failed = np.zeros((len(longest) >> 3) + 1, np.uint8)  # bit i: no encoding goes on from position i
        some = False
        chosen, came = np.full(len(longest), alone), np.zeros(len(longest), np.int64)  # the piece at a position, and the start of the one before it
        live = np.flatnonzero(begin < end)
        first, stop, pos = begin[live], end[live], begin[live]
        before, piece = np.full(len(pos), alone), longest[pos].astype(np.int64)
        while len(pos) >= FEW:
            while len(back := np.flatnonzero(piece < 0)):
                some, at = True, pos[back]
                np.bitwise_or.at(failed, at >> 3, (1 << (at & 7)).astype(np.uint8))
                pos[back] = last = came[at]
                piece[back] = shorter[chosen[last]]
                before[back] = np.where(last > first[back], chosen[came[last]], alone)
            to = pos + size[piece]
            ok = self.compatible(before, piece)
            if some:
                ok &= failed[to >> 3] >> (to & 7).astype(np.uint8) & 1 == 0
            chosen[pos[ok]], came[to[ok]] = piece[ok], pos[ok]
            before, pos = np.where(ok, piece, before), np.where(ok, to, pos)
            piece = np.where(ok, longest[pos], shorter[piece])
            on = pos < stop
            if not on.all():
                first, stop, pos, before, piece = first[on], stop[on], pos[on], before[on], piece[on]
        for start, stop, at, left, now in zip(*(x.tolist() for x in (first, stop, pos, before, piece)), strict=True):  # the same for the last ones
            while at < stop:
                while now >= 0:
                    to = at + int(size[now])
                    if not failed[to >> 3] >> (to & 7) & 1 and self.compatible(np.array([left]), np.array([now]))[0]:
                        break
                    now = int(shorter[now])
                if now >= 0:
                    chosen[at], came[to], left, at = now, at, now, to
                    now = int(longest[at])
                else:
                    failed[at >> 3] |= 1 << (at & 7)
                    at = int(came[at])
                    now = int(shorter[chosen[at]])
                    left = int(chosen[came[at]]) if at > start else alone
        on = np.zeros(len(longest), bool)
        at, stop = begin, end
        while len(at):
            inside = at < stop
            at, stop = at[inside], stop[inside]
            on[at] = True
            at = at + size[chosen[at]]
        return np.where(on, chosen, -1)[:-1]

    def encode_cuts(self, cuts: list[str]) -> Iterator[tuple[list[int], bool]]:
        """Ids of each cut, and whether they are pieces of text alone."""
        if not cuts:
            return
        text = self.gap.join(cuts).replace(" ", MARK)
        sizes = np.fromiter(map(len, cuts), np.int64, len(cuts))
        begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        chosen = self.backtrack(self.longest(text), begin, begin + sizes)
        place = np.flatnonzero(chosen >= 0)
        edges, found, lone = np.searchsorted(place, [*begin, len(text) + 1]).tolist(), chosen[place].tolist(), chosen[place] == self.alone
        some = np.add.reduceat(lone, edges[:-1]) if len(place) else np.zeros(len(cuts), int)
        for lo, hi, strange in zip(edges[:-1], edges[1:], some.tolist(), strict=True):
            ids = found[lo:hi]
            if strange:
                ids = []
                for i, at in zip(found[lo:hi], place[lo:hi].tolist(), strict=True):
                    if i != self.alone:
                        ids.append(i)
                    elif self.byte_ids:
                        ids += [self.byte_ids[b] for b in text[at].encode("utf-8")]
                    else:
                        ids.append(self.unk)
            yield ids, not strange

    def cuts(self, text: str) -> list[str]:
        """Parts of the text, with the leading space that the model adds, that are encoded each for itself."""
        return self.pattern.findall(" " + text.replace(MARK, " ")) if text else []

    def encode(self, text: str | None, eos: bool = False) -> list[int]:
        out = [i for ids, _ in self.encode_cuts(self.cuts(text or "")) for i in ids]
        return out + [self.eos] if eos else out

    def decode_part(self, ids: list[int]) -> str:
        special = self.byte_of
        out, raw = [], bytearray()
        for i in [*ids, None]:
            b = special.get(i)
            if b is not None:
                raw.append(b)
                continue
            if raw:
                out.append(lenient(bytes(raw)))
                raw = bytearray()
            if i is None or i in self.control:
                continue
            out.append(" ⁇ " if i in self.unknown else self.surface[i])
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """Text of ids: control ids vanish, byte ids join to characters (U+FFFD for each stray byte), one leading space goes."""
        text = self.decode_part(ids)
        first = next((i for i in ids if i not in self.control), None)
        return text[1:] if first is not None and text[:1] == " " and first not in self.byte_of and first not in self.unknown else text


def lenient(raw: bytes) -> str:
    """UTF-8 with one U+FFFD for each byte that belongs to no character."""
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[i : i + n].decode("utf-8"))
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


class Memo:
    """cut -> (ids joined by spaces, decoded text), for the cuts of a batch at a time. When half of MEMO_BYTES is full, its entries become the older generation, from which those in use return."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.young: dict[str, tuple[str, str]] = {}
        self.older: dict[str, tuple[str, str]] = {}
        self.bytes = 0
        self.digits = [str(i) for i in range(len(pieces.names))]

    def of(self, cuts: set[str]) -> dict[str, tuple[str, str]]:
        """Values of all these cuts."""
        young, older, digits = self.young, self.older, self.digits
        out, fresh = {}, []
        for cut in cuts:
            value = young.get(cut)
            if value is None:
                value = older.get(cut)
                if value is None:
                    fresh.append(cut)
                    continue
                self.keep(cut, value)
            out[cut] = value
        surface = self.pieces.surface
        for cut, (ids, plain) in zip(fresh, self.pieces.encode_cuts(fresh), strict=True):
            decoded = "".join([surface[i] for i in ids]) if plain else self.pieces.decode_part(ids)
            value = out[cut] = " ".join([digits[i] for i in ids]), cut if decoded == cut else decoded
            self.keep(cut, value)
        return out

    def keep(self, cut: str, value: tuple[str, str]) -> None:
        if self.bytes >= MEMO_BYTES // 2:
            self.older, self.young, self.bytes = self.young, {}, 0
        self.young[cut] = value
        self.bytes += ENTRY_BYTES + 2 * len(cut) + len(value[0])


def _memo(model: bytes) -> Memo:
    return held("pieces", hashlib.sha256(model).digest(), lambda: Memo(Pieces(model)))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """Ids and texts, about PART characters at a time."""
    for batch in batches:
        sizes = np.cumsum([x or 0 for x in pc.utf8_length(batch.column(1)).to_pylist()])
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + PART, side="right")))
            yield batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo).to_pylist()
            lo = hi


def encoded(memo: Memo, texts: list[str | None], eos: bool) -> Iterator[tuple[str, str]]:
    """Of each text the ids, joined by spaces, and what they decode to."""
    cuts = [memo.pieces.cuts(t or "") for t in texts]
    values = memo.of(set(chain.from_iterable(cuts)))
    for own in cuts:
        found = [values[c] for c in own]
        ids = " ".join([x[0] for x in found])
        decoded = "".join([x[1] for x in found])
        if eos:
            ids = f"{ids} {memo.pieces.eos}" if ids else str(memo.pieces.eos)
        yield ids, decoded[1:] if decoded[:1] == " " else decoded


def encode_texts(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", eos: bool = True, columns: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """One row per input row: the id, and of n_tokens, ids (array<int>, whole text), decoded (text of those ids), ids_sha256 (of the ids joined by spaces) and decoded_sha256 the named columns.

    The model file (under a megabyte) is read on the driver and travels with the plan, so executors need no file.
    """
    small_batches(df.sparkSession)
    with open(model_path, "rb") as f:
        model = f.read()
    kind = df.schema[id_col].dataType.simpleString()
    kinds = {"n_tokens": "bigint", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}

    def lists(ids: list[str]) -> pa.Array:
        ends = np.cumsum([x.count(" ") + 1 if x else 0 for x in ids])
        values = np.fromstring(" ".join([x for x in ids if x]), np.int32, sep=" ")
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values, pa.int32()))

    make = {
        "n_tokens": lambda ids, _: pa.array([x.count(" ") + 1 if x else 0 for x in ids], pa.int64()),
        "ids": lambda ids, _: lists(ids),
        "decoded": lambda _, decoded: pa.array(decoded, pa.string()),
        "ids_sha256": lambda ids, _: pa.array([hashlib.sha256(x.encode()).hexdigest() for x in ids], pa.string()),
        "decoded_sha256": lambda _, decoded: pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string()),
    }

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _memo(model)
        for names, texts in _parts(batches):
            found = list(encoded(memo, texts, eos))
            ids, decoded = [x[0] for x in found], [x[1] for x in found]
            yield pa.RecordBatch.from_arrays([names, *[make[c](ids, decoded) for c in columns]], [id_col, *columns])

    return df.select(id_col, text_col).mapInArrow(run, ", ".join([f"`{id_col}` {kind}", *[f"{c} {kinds[c]}" for c in columns]]))


def encode_digests(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", eos: bool = True) -> DataFrame:
    """As encode_texts, with the ids and the decoded text as digests: (id, n_tokens, ids_sha256, decoded_sha256)."""
    return encode_texts(df, model_path, id_col, text_col, eos, ("n_tokens", "ids_sha256", "decoded_sha256"))
