"""SentencePiece encoding and decoding by a streaming Viterbi search.

A text becomes a leading space, then the text, with spaces as visible marks. The model's scores are ranks of
merges, so the best path is not the one with the largest sum of scores: its encoding is what merging gives, best pair first, left
before right. A path of pieces is that encoding just where each two neighbours are the encoding of their joined
text: merging never undoes a piece, and what it does inside two neighbours does not depend on the text around them. So the
search lets a path go from piece a to piece b only if merging the characters of both gives a and b
back, which is found out once per pair and remembered. To each position at most one path survives. A character that no
piece covers becomes its UTF-8 byte pieces.

The search reads characters one by one. The path to a position is final when the position is
reached, and only paths to the last L positions (L: the longest piece) can be continued. Whenever
those paths run through one common boundary, the ids before it are committed and forgotten, so a
text of any length needs a window of a few L characters. Where no piece of the model crosses a
border (a mark after another character), all paths meet there, and the search commits at every border; the ids
between two borders are remembered in a dictionary of bounded size. Segments that are not remembered are searched side by side,
position by position; long ones one by one, by the stream.

Decoding joins the pieces' bytes, turns marks into spaces and drops the leading one. A null or empty
text has no ids; repeated rows and ids are encoded row by row. The ids are those of the library. The round trip is exact but for
U+2581, which the model's format cannot tell from a space.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from weekcraft.llm.common import arrow, code_points, column, read_table, steps, strings, tokenizer_path

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Segments that a task remembers (twice as many at most, and ``LOOKED_UP``, about 200 bytes each), and their longest; idle workers remember none.
REMEMBERED, REMEMBERED_CHARS = 250_000, 64
#: Segments looked up at once, those searched side by side, and how many new ones are worth that.
LOOKED_UP, SEARCHED, MANY = 1 << 15, 1 << 14, 64
#: Pairs of pieces that a process remembers; bits of the slots of those that the search side by side remembers.
PAIRS = 250_000
SLOT_BITS = 20
NEVER = -float("inf")


class PieceTable:
    """Pieces, scores and bytes of a model file, and which pieces may follow each other."""

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = size = sp.get_piece_size()
        self.ids: dict[str, int] = {}
        self.pieces: list[str] = [""] * size
        self.byte_ids = [0] * 256
        self.bytes: list[bytes] = [b""] * size
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value], self.bytes[i] = i, bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[piece], self.pieces[i] = i, piece
                self.bytes[i] = piece.replace(MARK, " ").encode("utf-8")
        self.scores = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        #: Pieces as a trie: character -> (id, or -1 where no piece ends; the nodes below).
        self.trie: dict = {}
        for piece, i in self.ids.items():
            node = self.trie
            for c in piece[:-1]:
                node = node.setdefault(c, [-1, {}])[1]
            node.setdefault(piece[-1], [-1, {}])[0] = i
        crossing = re.compile(f"[^{MARK}]{MARK}")
        self.borders = not any(crossing.search(p) for p in self.ids)
        self.follows: dict[int, bool] = {}
        #: Made where many texts are first searched.
        self.side: SideBySide | None = None

    # The number of a piece is its id; of a character without a piece, ``size`` + its code point; -1: no piece, -2: the text's start.

    def text_of(self, number: int) -> str:
        return self.pieces[number] if number < self.size else chr(number - self.size)

    def ids_of(self, number: int) -> list[int]:
        return [number] if number < self.size else [self.byte_ids[b] for b in chr(number - self.size).encode("utf-8")]

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text: the neighbours whose joined piece has the best score are merged, the left ones first."""
        parts, score = list(text), self.scores.get
        pair = [score(x + y, NEVER) for x, y in zip(parts, parts[1:], strict=False)]
        while pair and (best := max(pair)) != NEVER:
            k = pair.index(best)
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
            del pair[k]
            if k < len(pair):
                pair[k] = score(parts[k] + parts[k + 1], NEVER)
            if k:
                pair[k - 1] = score(parts[k - 1] + parts[k], NEVER)
        return parts

    def may_follow(self, a: int, b: int) -> bool:
        """Whether merging both pieces anew gives them back."""
        after = self.text_of(b)
        both = [after] if a == -2 else [self.text_of(a), after]
        joined = "".join(both)
        # Two pieces that make a piece would be merged.
        fits = (len(both) == 1 or joined not in self.scores) and self.merged(joined) == both
        if len(self.follows) >= PAIRS:
            self.follows.clear()
        self.follows[a << 21 | b] = fits
        return fits

    def push(self, text: str, last: list[int], begin: int, stop: int) -> None:
        """Continue the paths to the positions from ``begin`` to ``stop`` by every piece that fits; last: number of a path's last piece.

        A position that a path has reached is reached by no other, so its pairs are not looked up again.
        """
        get, n, known, may_follow = self.trie.get, len(text), self.follows.get, self.may_follow
        for i in range(begin, stop):
            a = last[i]
            if a == -1:
                continue
            node = get(text[i])
            b = node[0] if node is not None and node[0] >= 0 else self.size + ord(text[i])
            end, a = i + 1, a << 21
            while True:
                if b >= 0 and last[end] == -1:
                    fits = known(a | b)
                    if may_follow(last[i], b) if fits is None else fits:
                        last[end] = b
                if node is None or end == n:
                    break
                node = node[1].get(text[end])
                if node is None:
                    break
                b, end = node[0], end + 1

    def length(self, number: int) -> int:
        return len(self.pieces[number]) if number < self.size else 1

    def search_many(self, texts: list[str]) -> list[bytes]:
        """The ids of short texts, each from the start of a path."""
        if self.side is None:
            self.side = SideBySide(self)
        return self.side.search(texts)


class SideBySide:
    """The search of many short texts at once: all paths to a position are found together, then all to the next."""

    def __init__(self, table: PieceTable):
        self.table = table
        self.lengths = np.array([len(p) for p in table.pieces], dtype=np.int64)
        #: Number of a character, from 1; 0 of those that no piece holds.
        self.code = np.zeros(sys.maxunicode + 1, dtype=np.int32)
        letters = sorted({ord(c) for p in table.ids for c in p})
        self.code[letters] = np.arange(1, len(letters) + 1)
        # The trie as arrays: the edge by a character c from a node lies at first[node] + code[c], if from_[there] is the node.
        nodes, ends, below = [table.trie], [-1], []
        for node in nodes:
            below.append((self.code[[ord(c) for c in node]], range(len(nodes), len(nodes) + len(node))))
            for piece, children in node.values():
                ends.append(piece)
                nodes.append(children)
        size = 1 << (4 * len(nodes)).bit_length()
        self.piece, self.first = np.array(ends, dtype=np.int64), np.zeros(len(nodes), dtype=np.int64)
        self.from_, self.to = np.full(size + len(letters) + 1, -1), np.zeros(size + len(letters) + 1, dtype=np.int64)
        for k in sorted(range(len(nodes)), key=lambda k: -len(below[k][0])):
            codes, children = below[k]
            if not len(codes):
                break
            at = k * 0x9E3779B1 % size
            while (self.from_[at + codes] >= 0).any():
                at = (at * 5 + 1) % size
            self.first[k] = at
            self.from_[at + codes], self.to[at + codes] = k, children
        #: A pair of pieces, doubled, plus 1 if they may follow each other; a slot holds the latest pair that shares it.
        self.pairs = np.full(1 << SLOT_BITS, -1)

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces may follow each other; nothing follows -1."""
        pair = a << 21 | b
        slot = (pair.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOT_BITS)).view(np.int64)
        held = self.pairs[slot]
        new = np.flatnonzero((held >> 1 != pair) & (a != -1))
        fits = (held & 1).astype(bool) & (a != -1)
        if len(new):
            table = self.table
            found, at, back = np.unique(pair[new], return_index=True, return_inverse=True)
            known = [table.follows.get(p) for p in found.tolist()]
            first = new[at]
            each = np.array([table.may_follow(x, y) if k is None else k for k, x, y in zip(known, a[first].tolist(), b[first].tolist(), strict=True)])
            self.pairs[slot[first]] = found << 1 | each
            fits[new] = each[back]
        return fits

    def search(self, texts: list[str]) -> list[bytes]:
        """The ids of every text, which begins at the start of a path."""
        joined = "".join([t + "\0" for t in texts])
        chars = code_points(joined).astype(np.int64)
        sizes = np.array([len(t) + 1 for t in texts])
        ends = np.cumsum(sizes) - 1  # the place behind a text is its last position
        starts = ends - sizes + 1
        code = self.code[chars]
        code[ends] = 0
        offset = np.arange(len(chars)) - np.repeat(starts, sizes)
        inside = np.ones(len(chars), dtype=bool)
        inside[ends] = False

        # All pieces at all places, by their ends.
        at = np.flatnonzero(inside)
        node = np.zeros(len(at), dtype=np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(at):
            edge = self.first[node] + code[at + len(found)]
            there = self.from_[edge] == node
            node = self.to[edge[there]]
            piece = self.piece[node]
            if not found:  # a character is a step even if it is no piece
                number = self.table.size + chars[at]
                number[there] = np.where(piece >= 0, piece, number[there])
                found.append((at, number))
                at = at[there]
            else:
                at = at[there]
                found.append((at[piece >= 0], piece[piece >= 0]))
        begin, number = (np.concatenate(x) for x in zip(*found, strict=True))
        end = begin + np.repeat(np.arange(1, len(found) + 1), [len(x) for x, _ in found])
        step = offset[end - 1] + 1
        order = np.argsort(step.astype(np.uint16), kind="stable")
        begin, end, number = begin[order], end[order], number[order]

        last = np.full(len(chars), -1)
        last[starts] = -2
        cuts = np.cumsum(np.bincount(step))
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            fits = self.fits(last[begin[i:j]], number[i:j])
            last[end[i:j][fits]] = number[i:j][fits]

        # The paths, from the ends.
        text, at = np.arange(len(texts)), ends
        back: list[tuple[np.ndarray, np.ndarray]] = []
        while (left := at > starts[text]).any():
            text, at = text[left], at[left]
            number = last[at]
            back.append((text, number))
            at = at - np.where(number < self.table.size, self.lengths[np.minimum(number, self.table.size - 1)], 1)
        return self.bytes_of(back, len(texts))

    def bytes_of(self, back: list[tuple[np.ndarray, np.ndarray]], n: int) -> list[bytes]:
        """The ids of ``n`` texts; back: (texts, their last pieces), (texts, the ones before these), ..."""
        if not back:
            return [b""] * n
        text, number = (np.concatenate(x) for x in zip(*back, strict=True))
        each = np.bincount(text, minlength=n)
        at = np.cumsum(each)[text] - 1 - np.repeat(np.arange(len(back)), [len(x) for x, _ in back])
        numbers = np.empty_like(number)
        numbers[at] = number
        width = np.ones(len(numbers), dtype=np.int64)
        bare = np.flatnonzero(numbers >= self.table.size)
        chars, which = np.unique(numbers[bare], return_inverse=True)
        bytes_ = [self.table.ids_of(c) for c in chars.tolist()]
        width[bare] = np.array([len(x) for x in bytes_], dtype=np.int64)[which]
        ids = np.repeat(numbers, width)
        first = np.cumsum(width) - width
        for k in range(4):
            ours = width[bare] > k
            ids[first[bare[ours]] + k] = np.array([x[k] if len(x) > k else 0 for x in bytes_], dtype=np.int64)[which[ours]]
        raw = ids.astype("<i4").tobytes()
        cuts = (4 * np.r_[0, np.cumsum(width)][np.r_[0, np.cumsum(each)]]).tolist()
        return [raw[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]


_tables: dict[str, PieceTable] = {}


def piece_table(path: str) -> PieceTable:
    """The model's table, loaded once a process."""
    if path not in _tables:
        _tables[path] = PieceTable(path)
    return _tables[path]


class StreamEncoder:
    """Viterbi over a stream of characters with bounded memory; ``feed`` and ``finish`` return committed ids."""

    def __init__(self, table: PieceTable):
        self.table = table
        self.text = ""          # characters after the last commit
        self.last = [-2]        # the last piece on the path to each position after the last commit
        self.done = 0           # positions before this one are final and continued
        self.widest = 0         # the longest window so far, for tests
        self.commits = 0        # boundaries committed so far, for tests
        self.due = 4 * table.longest

    def feed(self, chars: str) -> list[int]:
        out: list[int] = []
        for i in range(0, len(chars), 64):
            self._extend(chars[i:i + 64], self.table.longest)
            if len(self.text) >= self.due:
                out += self._commit(self._meeting())
                self.due = len(self.text) + 4 * self.table.longest
        return out

    def finish(self) -> list[int]:
        self._extend("", 1)
        return self._commit(len(self.text))

    def border(self, segment: str) -> list[int]:
        """The ids of a segment between two borders, where all paths meet."""
        if len(segment) > self.due:
            out = self.feed(segment) + self.finish()
        else:  # the window holds it whole
            self._extend(segment, 1)
            out = self._commit(len(segment))
        self.last[0], self.due = -2, 4 * self.table.longest
        return out

    def _extend(self, chars: str, ahead: int) -> None:
        self.text += chars
        self.last += [-1] * len(chars)
        self.widest = max(self.widest, len(self.text))
        stop = max(self.done, len(self.text) - ahead + 1)  # where the longest piece fits
        self.table.push(self.text, self.last, self.done, stop)
        self.done = stop

    def _meeting(self) -> int:
        """The last boundary on all paths that can still be continued: those to ``done`` and over it."""
        length, path, meet = self.table.length, None, 0
        for at in range(self.done, min(len(self.text), self.done + self.table.longest) + 1):
            if self.last[at] == -1:
                continue
            own = [at]
            while own[-1]:
                own.append(own[-1] - length(self.last[own[-1]]))
            path = set(own) if path is None else path & set(own)
        for at in path or ():
            meet = max(meet, at)
        return meet

    def _commit(self, to: int) -> list[int]:
        if not to:
            return []
        numbers, at = [], to
        while at:
            numbers.append(self.last[at])
            at -= self.table.length(self.last[at])
        self.text, self.last = self.text[to:], self.last[to:]
        self.done -= to
        self.commits += 1
        ids_of = self.table.ids_of
        return [i for b in reversed(numbers) for i in ids_of(b)]


class Encoder:
    """Texts to ids and back, with a bounded memory of the segments met."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.table = piece_table(path)
        self.search = StreamEncoder(self.table)
        self.remembered = remembered
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def stream(self, chunks: Iterable[str]) -> Iterator[list[int]]:
        """Committed ids of a text that comes in chunks."""
        search, first = StreamEncoder(self.table), True
        for chunk in chunks:
            if chunk:
                chunk = chunk.replace(" ", MARK)
                yield search.feed(MARK + chunk if first else chunk)
                first = False
        yield search.finish()

    def _segments(self, keys: list[str]) -> list[bytes]:
        """The ids of segments, given without their first mark; short ones are remembered."""
        out = list(map(self.young.get, keys))
        found = dict.fromkeys(k for k, ids in zip(keys, out, strict=True) if ids is None)
        if not found:
            return out
        found = {k: self.old.get(k) for k in found}
        new = [k for k, ids in found.items() if ids is None and len(k) <= REMEMBERED_CHARS]
        if len(new) >= MANY:
            for i in range(0, len(new), SEARCHED):
                some = new[i:i + SEARCHED]
                found.update(zip(some, self.table.search_many([MARK + k for k in some]), strict=True))
        for k, ids in found.items():
            if ids is None:
                found[k] = np.array(self.search.border(MARK + k), dtype="<i4").tobytes()
        self.young.update((k, ids) for k, ids in found.items() if len(k) <= REMEMBERED_CHARS)
        if len(self.young) > self.remembered:
            self.young, self.old = {}, self.young
        return [found[k] if ids is None else ids for k, ids in zip(keys, out, strict=True)]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        if not self.table.borders:
            return [np.array([i for ids in self.stream([t]) for i in ids], dtype="<i4") for t in texts]
        keys: list[str] = []
        ends = [0]
        for text in texts:
            marked = text.replace(" ", MARK)
            if not text:
                pass
            elif marked[0] != MARK and MARK * 2 not in marked and marked[-1] != MARK:
                keys += marked.split(MARK)
            else:
                keys += [s[1:] for s in re.findall(f"{MARK}+[^{MARK}]*", MARK + marked)]
            ends.append(len(keys))
        ids = [x for i in range(0, len(keys), LOOKED_UP) for x in self._segments(keys[i:i + LOOKED_UP])]
        return [np.frombuffer(b"".join(ids[i:j]), dtype="<i4") for i, j in zip(ends, ends[1:], strict=False)]

    def decode(self, ids: Iterable[int]) -> str:
        piece = self.table.bytes
        return b"".join([piece[i] for i in ids])[1:].decode("utf-8")


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                 remembered: int = REMEMBERED) -> DataFrame:
    """One row per row: doc_id, n_chars, n_tokens, ids array<int>, round_trip (decoding gives the text back); no shuffle."""
    path = path or tokenizer_path(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(path, remembered)
        for batch in batches:
            for part in steps(batch):
                texts = strings(part)
                ids = enc.encode_all(texts)
                sizes = np.array([len(i) for i in ids], dtype=np.int64)
                same = [enc.decode(i.tolist()) == t.replace(MARK, " ") for i, t in zip(ids, texts, strict=True)]
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    column(part, "doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(sizes),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())),
                    pa.array(same, pa.bool_())], names=["doc_id", "n_chars", "n_tokens", "ids", "round_trip"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).transform(
        arrow,
        run, "doc_id long, n_chars long, n_tokens long, ids array<int>, round_trip boolean")


def decode_ids(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """One row per row: doc_id, text; a null list of ids gives the empty text."""
    path = path or tokenizer_path(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array([enc.decode(i or []) for i in column(batch, "ids").to_pylist()], pa.string())],
                                             names=["doc_id", "text"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).transform(arrow, run, "doc_id long, text string")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every text by a streaming Viterbi search, and whether they decode to the text."""
    return encode_texts(read_table(spark, sf_dir, "documents"))
