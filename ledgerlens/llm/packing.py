"""Hierarchical multi-length packing of tokenised documents.

Documents are routed to context-size tiers (powers of two), each tier is packed longest first, gaps in longer windows
are filled from shorter tiers, and sequences are dealt to step groups of equal attention cost. Each task packs its own
share of the rows with a bounded buffer; what is left at its end is cut into windows of power-of-two length, so that
only complete windows exist and none is padded.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import pick

TIERS = (512, 1024, 2048, 4096)
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, tier int, step_group long"
#: Separators that only one of Python and the tokenizer takes as blanks.
_ODD_BLANKS = "\x1c\x1d\x1e\x1f"
#: Lower-case characters whose composition and class are the same for Python and the tokenizer, and its pieces of them.
_SIMPLE = re.compile("[!-@\\[-~ß-öø-ÿ]+")
_PIECE = re.compile(r"'(?:[stmd]|re|ve|ll)|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
#: The tokenizer's pattern that `_PIECE` follows; tokenizers with another one encode whole texts.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_BLANK, _LETTER, _DIGIT, _SIGN, _OTHER = range(5)
_CLASS = np.array([_BLANK if c in b"\t\n\v\f\r \x85\xa0" else _DIGIT if c in b"0123456789" else _OTHER if c < 33 or 126 < c < 192 else _LETTER if chr(c).isalpha() else _SIGN for c in range(256)], np.uint8)
_PLAIN = bytes(np.flatnonzero((_CLASS == _BLANK) | (_CLASS == _LETTER)).astype(np.uint8))
_BLOCK = 256  # pieces given to the tokenizer as one text
_WHOLE = "\0"  # marks a word that the tokenizer has to encode itself


class _Numbers(dict):
    """Numbers its keys as they are first looked up."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.fresh.append(key)
        return n


class WordEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, the end id last.

    The tokenizer drops white space and cuts the rest into pieces that it never joins, so ids are looked up by piece. Texts
    of plain Latin letters, digits and ASCII signs are cut here; where no two signs stand together and there is no
    apostrophe, blanks around each sign and digit do that. New pieces go through the tokenizer's merges alone, many at a
    time: they are lower case and need neither normalising nor splitting, and a piece ends where an id does that stands
    for the end of a word. In other texts each word of other characters is encoded by the tokenizer; texts with
    separators that only one of Python and the tokenizer takes as blanks are encoded whole. The table is emptied when full.
    """

    def __init__(self, path: str, end_id: int, most: int = 600_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs as many tasks as there are cores
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.merges = Tokenizer.from_file(path), Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        steps = [n.get("type") for n in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = [p.get("pattern", {}).get("Regex") for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.by_piece = splits[:1] == [_PATTERN] and "Lowercase" in steps and spec["model"].get("end_of_word_suffix") == "</w>"
        self.merges.normalizer = None
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        signs = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.signs = {c: "".join(part for part, _ in signs.pre_tokenize_str(chr(c))) for c in range(0x80, 0x100)}
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.end, self.most = np.array([end_id], "<u4").tobytes(), most
        self._clear()

    def _clear(self) -> None:
        self.numbers = _Numbers()
        self.numbers.fresh = []
        self.ids, self.n_ids = np.zeros(1 << 16, "<u4"), 0  # of all pieces, one after another
        self.stops, self.n_pieces = np.zeros(1 << 14, np.int64), 0  # where each piece's ids end; that of piece k at k + 1

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _keep(self, ids: np.ndarray, stops: np.ndarray) -> None:
        while self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n_pieces + len(stops) + 1 > len(self.stops):
            self.stops = np.concatenate([self.stops, np.zeros_like(self.stops)])
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.stops[self.n_pieces + 1 : self.n_pieces + 1 + len(stops)] = self.n_ids + stops
        self.n_ids, self.n_pieces = self.n_ids + len(ids), self.n_pieces + len(stops)

    def _learn(self) -> None:
        """The ids of the fresh pieces, in the order of their numbers."""
        fresh, self.numbers.fresh = self.numbers.fresh, []
        blocks = [fresh[at : at + _BLOCK] for at in range(0, len(fresh), _BLOCK)]
        texts = ["\n".join(b).translate(self.signs) for b in blocks]
        for block, text, encoded in zip(blocks, texts, self.merges.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(encoded.ids, "<u4")
            stops = np.flatnonzero(self.last[ids]) + 1
            if _WHOLE in text or len(stops) != len(block):
                each = self._encode([p.removeprefix(_WHOLE) for p in block])
                ids, stops = np.concatenate(each), np.cumsum([len(e) for e in each])
            self._keep(ids, stops)

    def _pieces(self, text: str) -> list[str] | None:
        """Numbers' keys; null for a text that has to be encoded whole."""
        if not self.by_piece or any(c in text for c in _ODD_BLANKS):
            return None
        try:
            raw = b"" if "<|" in text else text.encode("latin-1")
        except UnicodeEncodeError:
            raw = b""
        kinds = _CLASS[np.frombuffer(raw, np.uint8)]
        if not raw or (kinds == _OTHER).any():
            out = []
            for word in text.split():
                low = word.lower()
                out.extend(_PIECE.findall(low) if _SIMPLE.fullmatch(low) and "<|" not in low else (_WHOLE + word,))
            return out
        low, signs = text.lower(), kinds == _SIGN
        if "'" in text or (signs[1:] & signs[:-1]).any():
            return _PIECE.findall(low)
        for c in set(raw.translate(None, _PLAIN)):
            low = low.replace(chr(c), f" {chr(c)} ")
        return low.split()

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.numbers) > self.most:
            self._clear()
        number = self.numbers.__getitem__
        coded = []
        for pieces in map(self._pieces, texts):
            coded.append(None if pieces is None else np.fromiter(map(number, pieces), np.int64, len(pieces)))
        self._learn()
        out = []
        for text, code in zip(texts, coded, strict=True):
            if code is None:
                ids = self._encode([text])[0]
            else:
                count = self.stops[code + 1] - self.stops[code]
                shift = self.stops[code] - np.cumsum(count) + count
                ids = self.ids[np.arange(int(count.sum())) + np.repeat(shift, count)]
            out.append(ids.tobytes() + self.end)
        return out


_ENCODERS: dict[tuple[str, int], WordEncoder] = {}


def encoder(path: str, end_id: int) -> WordEncoder:
    """One per Python worker, which Spark reuses from task to task."""
    return _ENCODERS.get((path, end_id)) or _ENCODERS.setdefault((path, end_id), WordEncoder(path, end_id))


class Packer:
    """Places pieces [doc, start, length] of the documents it is given; emits finished windows."""

    def __init__(self, first_id: int, window: int, tiers: tuple[int, ...], group_windows: int) -> None:
        self.next_id, self.window, self.tiers, self.group_windows = first_id, window, tiers, group_windows
        self.pool: list[tuple[int, int, int]] = []  # (length, start, document), sorted
        self.docs: dict[int, list] = {}  # document: [doc_id, ids, tokens, pieces still in the pool]
        self.next_doc, self.held, self.groups = 0, 0, first_id
        self.done: list[tuple[int, list[tuple[int, int, int]]]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        key, total = self.next_doc, len(ids) // 4
        self.next_doc += 1
        self.docs[key] = [doc_id, ids, total, 0]
        start = 0
        while total - start >= self.window:
            self.done.append((self.window, [(self.window, start, key)]))
            start += self.window
        if start < total:
            insort(self.pool, (total - start, start, key))
            self.held += total - start

    def _take_up_to(self, room: int) -> tuple[int, int, int] | None:
        at = bisect_right(self.pool, (room, 1 << 62, 0)) - 1
        if at < 0:
            return None
        self.held -= self.pool[at][0]
        return self.pool.pop(at)

    def _fill(self, size: int, pieces: list[tuple[int, int, int]]) -> None:
        room = size - sum(p[0] for p in pieces)
        while room:
            piece = self._take_up_to(room)
            if piece is None:  # the shortest is longer than the gap: cut it
                length, start, key = self.pool.pop(0)
                self.held -= room
                insort(self.pool, (length - room, start + room, key))
                piece = (room, start, key)
            pieces.append(piece)
            room -= piece[0]
        self.done.append((size, pieces))

    def pack(self) -> None:
        """Each tier from the longest: a document of that tier opens a window, shorter ones fill it."""
        for k in reversed(range(len(self.tiers))):
            size, floor = self.tiers[k], self.tiers[k - 1] if k else 0
            while self.pool and floor < self.pool[-1][0] <= size <= self.held:
                piece = self.pool.pop()
                self.held -= piece[0]
                self._fill(size, [piece])

    def finish(self) -> None:
        self.pack()
        while self.held:
            self._fill(1 << (min(self.held, self.window).bit_length() - 1), [])

    def emit(self) -> pa.RecordBatch | None:
        if not self.done:
            return None
        columns: list[list] = [[] for _ in range(10)]
        by_tier: dict[int, list[tuple[int, list]]] = {}
        for size, pieces in self.done:
            by_tier.setdefault(size, []).append((size, pieces))
        for size, windows in sorted(by_tier.items()):
            windows.sort(key=lambda w: -sum(p[0] ** 2 for p in w[1]))
            groups = -(-len(windows) // self.group_windows)
            for n, (_, pieces) in enumerate(windows):
                lap, at = divmod(n, groups)
                group = self.groups + (groups - 1 - at if lap % 2 else at)
                offset = 0
                for length, start, key in pieces:
                    doc_id, ids, total, _ = self.docs[key]
                    row = (doc_id, start, length, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)]), total, self.next_id, offset, size, size, group)
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
                    offset += length
                self.next_id += 1
            self.groups += groups
        self.done = []
        waiting = {key for _, _, key in self.pool}
        self.docs = {key: doc for key, doc in self.docs.items() if key in waiting}
        kinds = [pa.int64()] * 8 + [pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [part.split()[0] for part in SCHEMA.split(", ")])


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = 4096, end_id: int = 2, tiers: tuple[int, ...] = TIERS, buffer_tokens: int = 4 << 20, group_windows: int = 8) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length, tier, step_group.

    Every id of every document, `end_id` last, lies in one piece; a null or empty text is one piece of length 1.
    Rows are packed as they are, so repeated rows or ids are packed once per row, and a null id stays null.
    An empty table gives an empty result; other columns of the input are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, end_id)
        packer = Packer(TaskContext.get().partitionId() << 36, window, tiers, group_windows)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for doc_id, ids in zip(part.column(0).to_pylist(), encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    packer.add(doc_id, ids)
                if packer.held >= buffer_tokens or len(packer.done) >= 256:
                    if packer.held >= buffer_tokens:
                        packer.pack()
                    if (out := packer.emit()) is not None:
                        yield out
        packer.finish()
        if (out := packer.emit()) is not None:
            yield out

    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, SCHEMA)
