"""Token ids in wavelet matrices: one succinct file for each shard of consecutive documents.

A shard file holds the ids of its documents, in ascending document order, as bit planes
from the highest bit down. Each plane is split stably into zeros and ones; counts of ones
per block are stored beside them and give rank and select, so one file answers access, count and
occurrence lookup from its own bytes, without being decoded. Layout, little endian:

    magic b"TWM2", u32 planes, u64 ids, u64 documents
    i64 document ids, u8 "document id is null", u64 end position of each document
    for each plane: u64 zeros, the packed bits, u32 ones before each block of 512 bits

Defined cases: a null text is an empty one, so it holds the end id alone; null document
ids come first; rows with the same id keep the order of their texts; an empty table makes
no shard.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripwise.llm.tables import parts_for
from tripwise.llm.words import byte_values, mixed, per_worker, powers, slices
from tripwise.operators.ranks import running_sums
from tripwise.sources.shared import fresh_path, written

MAGIC = b"TWM2"
END_ID = 0
#: Ids of one shard, as 32-bit numbers, and text of one task.
SHARD_BYTES = 8 << 20
TASK_BYTES = 200 << 20
LEAST_RANGES = 24
KEY_CHARS = 32
#: Text that is cut into chunks at once.
SLICE_BYTES = 1 << 20
BLOCK = 512
#: What a worker remembers of chunks, their ids and hashes.
CACHED_BYTES = 48 << 20
JOINED_PIECES = 64
# How byte-level vocabularies spell a space and a line feed.
BYTE_SPACE = "Ġ"
BYTE_LINE = "Ċ"
# ASCII letters; ASCII characters that are neither letter nor white; second bytes of U+00C0 to U+00FF without the two signs.
LETTERS, MARKS, ACCENTED = np.zeros((3, 256), bool)
LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
MARKS[0x21:0x7F] = ~LETTERS[0x21:0x7F]
ACCENTED[0x80:0xC0] = True
ACCENTED[[0x97, 0xB7]] = False
WIDE_SPACES = [c.encode() for c in map(chr, range(0x80, 0x3001)) if c.isspace()]


class WaveletMatrix:
    """Read access to the ids of one shard file; holds the file's bytes and no others."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("Not a wavelet matrix file")
        planes, self.size, self.docs = struct.unpack_from("<IQQ", payload, 4)
        self.payload = payload
        at = 24 + 9 * self.docs
        self.ends = np.frombuffer(payload, "<u8", self.docs, at)
        at += 8 * self.docs
        self.bits, self.zeros, self.ranks = [], [], []
        packed, blocks = -(-self.size // 8), -(-self.size // BLOCK)
        for _ in range(planes):
            self.zeros.append(struct.unpack_from("<Q", payload, at)[0])
            self.bits.append(np.frombuffer(payload, np.uint8, packed, at + 8))
            self.ranks.append(np.frombuffer(payload, "<u4", blocks, at + 8 + packed))
            at += 8 + packed + 4 * blocks

    @property
    def doc_ids(self) -> list[int | None]:
        ids = np.frombuffer(self.payload, "<i8", self.docs, 24).tolist()
        null = np.frombuffer(self.payload, "u1", self.docs, 24 + 8 * self.docs).tolist()
        return [None if gone else i for i, gone in zip(ids, null)]

    def _block(self, plane: int, block: int) -> np.ndarray:
        """The bits of one block."""
        first = block * BLOCK // 8
        held = self.bits[plane][first : first + BLOCK // 8]
        return np.unpackbits(held, count=min(BLOCK, self.size - block * BLOCK))

    def _ones(self, plane: int, at: int) -> int:
        """Ones among the first ``at`` bits of a plane."""
        block, rest = divmod(at, BLOCK)
        if block == len(self.ranks[plane]):
            return self.size - self.zeros[plane]
        ones = int(self.ranks[plane][block])
        return ones + int(self._block(plane, block)[:rest].sum()) if rest else ones

    def access(self, at: int) -> int:
        """The id at a position."""
        value = 0
        for plane in range(len(self.bits)):
            bit = int(self.bits[plane][at >> 3]) >> (7 - (at & 7)) & 1
            ones = self._ones(plane, at)
            at = self.zeros[plane] + ones if bit else at - ones
            value = value << 1 | bit
        return value

    def _range(self, value: int, stop: int) -> tuple[int, int]:
        low, high = 0, stop
        if value >> len(self.bits):
            return 0, 0
        for plane in range(len(self.bits)):
            ones_low, ones_high = self._ones(plane, low), self._ones(plane, high)
            if value >> (len(self.bits) - 1 - plane) & 1:
                low, high = self.zeros[plane] + ones_low, self.zeros[plane] + ones_high
            else:
                low, high = low - ones_low, high - ones_high
        return low, high

    def count(self, value: int, stop: int | None = None) -> int:
        """Occurrences of an id before position ``stop`` (all by default): rank."""
        low, high = self._range(value, self.size if stop is None else stop)
        return high - low

    def occurrence(self, value: int, k: int) -> int:
        """Position of the ``k``-th (from 0) occurrence of an id: select."""
        low, high = self._range(value, self.size)
        if not 0 <= k < high - low:
            raise IndexError(f"Id {value} has {high - low} occurrences")
        at = low + k
        for plane in reversed(range(len(self.bits))):
            one = value >> (len(self.bits) - 1 - plane) & 1
            at = self._select(plane, one, at - self.zeros[plane] if one else at)
        return at

    def _select(self, plane: int, one: int, k: int) -> int:
        """Position of the ``k``-th one or zero of a plane, by halving its blocks."""
        ranks = self.ranks[plane]

        def before(block: int) -> int:
            return int(ranks[block]) if one else block * BLOCK - int(ranks[block])

        low, high = 0, len(ranks)
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if before(middle) <= k else (low, middle)
        inside = np.flatnonzero(self._block(plane, low) == one)
        return low * BLOCK + int(inside[k - before(low)])

    def decode(self) -> np.ndarray:
        """All ids: merges zeros and ones back, from the lowest plane to the highest."""
        values = np.zeros(self.size, np.uint16 if len(self.bits) <= 16 else np.uint32)
        for k, (packed, zeros) in enumerate(zip(reversed(self.bits), reversed(self.zeros))):
            one = np.unpackbits(packed, count=self.size).view(bool)
            merged = np.empty_like(values)
            merged[one] = values[zeros:] | values.dtype.type(1 << k)
            merged[~one] = values[:zeros]
            values = merged
        return values.astype(np.uint32)


def encode_shard(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, planes: int) -> bytes:
    """The bytes of one shard file."""
    if len(ids) and int(ids.max()) >> planes:
        raise ValueError(f"An id needs more than {planes} bits")
    out = [
        MAGIC,
        struct.pack("<IQQ", planes, len(ids), len(doc_ids)),
        np.array([i or 0 for i in doc_ids], "<i8").tobytes(),
        np.array([i is None for i in doc_ids], "u1").tobytes(),
        np.cumsum(lengths).astype("<u8").tobytes(),
    ]
    ids = ids.astype(np.uint16 if planes <= 16 else np.uint32)
    for plane in reversed(range(planes)):
        bits = (ids & ids.dtype.type(1 << plane)) != 0
        packed = np.packbits(bits)
        whole = np.zeros(-(-len(bits) // BLOCK) * (BLOCK // 8), np.uint8)
        whole[: len(packed)] = packed
        sums = np.bitwise_count(whole).reshape(-1, BLOCK // 8).sum(1, dtype=np.int64)
        ranks = np.cumsum(sums) - sums
        ones = ids[bits]
        out += [struct.pack("<Q", len(ids) - len(ones)), packed.tobytes(), ranks.astype("<u4").tobytes()]
        ids = np.concatenate([ids[~bits], ones])
    return b"".join(out)


def _white(data: np.ndarray) -> np.ndarray:
    """Bytes of white space characters, those beyond ASCII among them."""
    white = np.zeros(256, bool)
    white[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
    out = white[data]
    for lead in WIDE_SPACES:
        at = np.flatnonzero(data == lead[0])
        at = at[at + len(lead) <= len(data)]
        for i, byte in enumerate(lead[1:], 1):
            at = at[data[at + i] == byte]
        for i in range(len(lead)):
            out[at + i] = True
    return out


def _letters(data: np.ndarray) -> np.ndarray:
    """The last bytes of ASCII letters and of those of U+00C0 to U+00FF."""
    out = LETTERS[data]
    out[1:] |= (data[:-1] == 0xC3) & ACCENTED[data[1:]]
    return out


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of the spans, one span after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Encoder:
    """Whole texts to ids with the tokenizers library.

    Byte-level pre-tokenisation always cuts before a single space that stands between two
    characters that are not white space, around a line feed that does, and between a letter and an ASCII character
    that is neither letter nor white. So a text is the chain of the chunks that begin there, and a
    chunk that comes back needs no second run of the library. The chunks of many texts are
    told apart by hashes at once, compared with the first of their kind byte by byte, and
    only one of each kind is looked up or run. What is known lies in a few arrays in order of the hashes.
    """

    def __init__(self, path: str):
        # Tasks are the parallelism; threads of the library would only wait for each other.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._forget()
        tokens = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(tokens.values()) + 1, bool)
        self.spaced[[i for token, i in tokens.items() if token.startswith(BYTE_SPACE)]] = True
        self.line = np.zeros(len(self.spaced), bool)
        self.line[[i for token, i in tokens.items() if token == BYTE_LINE]] = True
        # Tokens that are found before pre-tokenisation: no cut may fall into them.
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _forget(self) -> None:
        # Known chunks: hashes in order and the entry of each; bytes and ids of the entries one after the other.
        self.hashes, self.entry = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.text, self.text_ends = np.empty(0, np.uint8), np.zeros(1, np.int64)
        self.ids, self.id_ends = np.empty(0, np.uint32), np.zeros(1, np.int64)

    @property
    def held(self) -> int:
        arrays = (self.hashes, self.entry, self.text, self.text_ends, self.ids, self.id_ends)
        return sum(a.nbytes for a in arrays) if len(self.hashes) else 0

    def _run(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for at in range(0, len(texts), 4096):
            found = self.tokenizer.encode_batch_fast(texts[at : at + 4096], add_special_tokens=False)
            out += [np.array(f.ids, np.uint32) for f in found]
        return out

    def _run_joined(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, lines: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks and how many each has; some chunks run as one text, cut at the ids that begin with a space.

        ``lines``: chunks without white space, with a line feed put behind each; else each is one space and a word.
        """
        wide = lengths + lines
        upto = np.concatenate([[0], np.cumsum(wide)])
        joined = np.full(upto[-1], 0x0A, np.uint8)
        joined[_spans(upto[:-1], lengths)] = data[_spans(starts, lengths)]
        raw = joined.tobytes()
        cuts = np.append(np.arange(0, len(starts), JOINED_PIECES), len(starts))
        found = self._run([raw[upto[a] : upto[b]].decode() for a, b in zip(cuts, cuts[1:])])
        ids, counts = [], []
        for a, b, own in zip(cuts.tolist(), cuts[1:].tolist(), found):
            at = np.flatnonzero((self.line if lines else self.spaced)[own])
            if len(at) != b - a:
                alone = self._run([raw[upto[i] : upto[i] + lengths[i]].decode() for i in range(a, b)])
                ids += alone
                counts.append(np.array([len(i) for i in alone], np.int64))
            elif lines:
                ids.append(own[~self.line[own]])
                counts.append(np.diff(at, prepend=-1) - 1)
            else:
                ids.append(own)
                counts.append(np.diff(at, append=len(own)))
        return np.concatenate(ids), np.concatenate(counts)

    def _fresh(self, data: np.ndarray, white: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks from the library, one after the other, and how many each has."""
        whites = np.concatenate([[0], np.cumsum(white, dtype=np.int64)])
        whites = whites[starts + lengths] - whites[starts]
        kinds = np.where((whites == 1) & (data[starts] == 0x20) & (lengths > 1), 0, np.where(whites == 0, 1, 2))
        order = np.argsort(kinds, kind="stable")
        cuts = np.searchsorted(kinds[order], np.arange(4))
        found = []
        for kind in range(2):
            own = order[cuts[kind] : cuts[kind + 1]]
            if len(own):
                found.append(self._run_joined(data, starts[own], lengths[own], lines=kind == 1))
        rest = order[cuts[2] :].tolist()
        if rest:
            alone = self._run([data[starts[i] : starts[i] + lengths[i]].tobytes().decode() for i in rest])
            found.append((np.concatenate(alone), np.array([len(i) for i in alone], np.int64)))
        flat, counts = (np.concatenate(c) for c in zip(*found))
        # Back from the order of the kinds.
        back = np.argsort(order)
        return flat[_spans((np.cumsum(counts) - counts)[back], counts[back])], counts[back]

    def _learned(
        self, data: np.ndarray, white: np.ndarray, starts: np.ndarray, lengths: np.ndarray, hashes: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each chunk and how many; new ones are run and remembered up to ``CACHED_BYTES``."""
        place = np.searchsorted(self.hashes, hashes)
        met = np.zeros(len(starts), bool)
        inside = place < len(self.hashes)
        met[inside] = self.hashes[place[inside]] == hashes[inside]
        entry = np.zeros(len(starts), np.int64)
        entry[met] = self.entry[place[met]]
        # Equal hashes are known chunks only if their bytes are equal.
        met[met] = lengths[met] == np.diff(self.text_ends)[entry[met]]
        same = np.ones(int(lengths[met].sum()) + 1, bool)
        same[:-1] = data[_spans(starts[met], lengths[met])] == self.text[_spans(self.text_ends[entry[met]], lengths[met])]
        firsts = np.cumsum(lengths[met]) - lengths[met]
        if met.any():
            met[met] = np.logical_and.reduceat(same, firsts) & (lengths[met] > 0)
        counts = np.zeros(len(starts), np.int64)
        counts[met] = np.diff(self.id_ends)[entry[met]]
        new = np.flatnonzero(~met)
        fresh, counts_new = np.empty(0, np.uint32), np.empty(0, np.int64)
        if len(new):
            fresh, counts_new = self._fresh(data, white, starts[new], lengths[new])
            counts[new] = counts_new
        out = np.empty(int(counts.sum()), np.uint32)
        at = np.cumsum(counts) - counts
        out[_spans(at[met], counts[met])] = self.ids[_spans(self.id_ends[entry[met]], counts[met])]
        out[_spans(at[new], counts_new)] = fresh
        if len(new):
            self._remember(data, starts[new], lengths[new], hashes[new], fresh, counts_new)
        return out, counts

    def _remember(
        self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, hashes: np.ndarray, ids: np.ndarray, counts: np.ndarray
    ) -> None:
        """Add chunks whose hash is not held yet."""
        _, first = np.unique(hashes, return_index=True)
        place = np.searchsorted(self.hashes, hashes[first])
        inside = place < len(self.hashes)
        held = np.zeros(len(first), bool)
        held[inside] = self.hashes[place[inside]] == hashes[first[inside]]
        first = first[~held]
        size = int(lengths[first].sum() + 4 * counts[first].sum()) + 32 * len(first) + 16
        if size > CACHED_BYTES:
            return
        if max(self.held, 16) + size > CACHED_BYTES:
            self._forget()
        place = np.searchsorted(self.hashes, hashes[first])
        self.entry = np.insert(self.entry, place, np.arange(len(first)) + len(self.hashes))
        self.hashes = np.insert(self.hashes, place, hashes[first])
        self.text = np.concatenate([self.text, data[_spans(starts[first], lengths[first])]])
        self.text_ends = np.concatenate([self.text_ends, self.text_ends[-1] + np.cumsum(lengths[first])])
        before = np.cumsum(counts) - counts
        self.ids = np.concatenate([self.ids, ids[_spans(before[first], counts[first])]])
        self.id_ends = np.concatenate([self.id_ends, self.id_ends[-1] + np.cumsum(counts[first])])

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each text has."""
        texts = column.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset :][: len(texts) + 1]
        held = texts.buffers()[2]
        data = np.frombuffer(held, np.uint8) if held is not None else np.empty(0, np.uint8)
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        white = _white(data)
        cut = np.zeros(len(data), bool)
        cut[1:-1] = ((data[1:-1] == 0x20) | (data[1:-1] == 0x0A)) & ~white[:-2] & ~white[2:]
        # White space at the beginning or the end of a text has no neighbour there.
        filled = offsets[:-1] < offsets[1:]
        cut[offsets[1:][filled] - 1] = False
        cut[offsets[:-1][filled]] = False
        behind = np.flatnonzero(cut & (data == 0x0A)) + 1
        cut[behind] = True
        whole = data.tobytes()
        if not any(token in whole for token in self.added):
            cut[1:] |= _letters(data)[:-1] & MARKS[data[1:]]
        cut[offsets[:-1][filled]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        at, found = 0, []
        while at < len(starts):
            stop = max(at + 1, int(np.searchsorted(ends, starts[at] + SLICE_BYTES, "right")))
            low = starts[at]
            span = slice(low, ends[stop - 1])
            found.append(self._chunks(data[span], white[span], starts[at:stop] - low, ends[at:stop] - low))
            at = stop
        flat, counts = (np.concatenate(c) for c in zip(*found))
        upto = np.concatenate([[0], np.cumsum(counts)])
        return flat, np.diff(upto[np.searchsorted(starts, offsets)])

    def _chunks(
        self, data: np.ndarray, white: np.ndarray, starts: np.ndarray, ends: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks one after the other, and how many each has."""
        lengths = ends - starts
        power, inverse = powers(0x9E3779B97F4A7C15, len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(byte_values()[data] * power[: len(data)], out=sums[1:])
        hashes = mixed((sums[ends] - sums[starts]) * inverse[starts] + lengths.astype(np.uint64))
        _, first, kind = np.unique(hashes, return_index=True, return_inverse=True)
        same = (lengths == lengths[first][kind]).all()
        if not (same and (data == data[_spans(starts[first][kind], lengths)]).all()):
            # Two kinds share a hash: every chunk stands for itself.
            first = kind = np.arange(len(starts))
        ids, sizes = self._learned(data, white, starts[first], lengths[first], hashes[first])
        counts = sizes[kind]
        return ids[_spans((np.cumsum(sizes) - sizes)[kind], counts)], counts

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        ids, counts = self.encode_column(pa.array(texts, pa.large_string()))
        ends = np.cumsum(counts)
        return [ids[a:b].tobytes() for a, b in zip(ends - counts, ends)]


def write_shards(
    docs: DataFrame,
    tokenizer: str,
    path: str,
    key: str = "doc_id",
    text: str = "text",
    planes: int = 16,
    end_id: int = END_ID,
    shard_bytes: int = SHARD_BYTES,
    task_bytes: int = TASK_BYTES,
) -> int:
    """Encode all documents and write one wavelet matrix for each range of documents.

    A task takes a range of ``(key, text)`` of about ``task_bytes`` of text and cuts it into shards of
    about ``shard_bytes``, each a row (``seq``, ``payload``) of its committed Parquet file. Returns the
    number of ranges.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    n_bytes = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ranges = parts_for(n_bytes, LEAST_RANGES, task_bytes)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = np.ones(batch.num_rows, bool)
            id_, text = batch["id"], batch["text"]
            null = id_.is_null().to_numpy(False)
            value = id_.fill_null(0).to_numpy()
            same = pc.equal(text[1:], text[:-1]).to_numpy(False)
            first[1:] = (null[1:] != null[:-1]) | (value[1:] != value[:-1]) | ~same
            at = np.flatnonzero(first)
            copies = np.diff(np.append(at, batch.num_rows))
            yield pa.RecordBatch.from_arrays([id_.take(pa.array(at)), text.take(pa.array(at)), pa.array(copies)], ["id", "text", "copies"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_worker(f"encoder_{tokenizer}", lambda: Encoder(tokenizer))
        doc_ids, lengths, parts = [], [], []
        size = seq = 0

        def closed() -> pa.RecordBatch:
            payload = encode_shard(doc_ids, np.concatenate(lengths), np.concatenate(parts), planes)
            columns = [pa.array([seq], pa.int64()), pa.array([payload], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["seq", "payload"])

        for batch in batches:
            ids_of, copies = batch["id"].to_pylist(), batch["copies"].to_numpy()
            for low, high in slices(batch["text"], SLICE_BYTES):
                ids, counts = encoder.encode_column(batch["text"].slice(low, high - low))
                # The end id behind each text, then each text as often as it follows itself.
                whole = counts + 1
                ended = np.full(int(whole.sum()), end_id, np.uint32)
                ended[_spans(np.cumsum(whole) - whole, counts)] = ids
                n = copies[low:high]
                if (n > 1).any():
                    ended = ended[_spans(np.repeat(np.cumsum(whole) - whole, n), np.repeat(whole, n))]
                doc_ids += [i for i, k in zip(ids_of[low:high], n.tolist()) for _ in range(k)]
                lengths.append(np.repeat(whole, n))
                parts.append(ended)
                size += 4 * len(ended)
                if size >= shard_bytes:
                    yield closed()
                    doc_ids, lengths, parts = [], [], []
                    size, seq = 0, seq + 1
        if doc_ids:
            yield closed()

    # Equal rows that follow each other, as a mix of sources leaves them, move and are encoded once.
    rows = rows.mapInArrow(runs, "id bigint, text string, copies bigint")
    # Range sampling sends keys to the driver: ids and short beginnings, which order texts alike.
    ordered = rows.repartitionByRange(ranges, F.col("id").asc_nulls_first(), F.substring("text", 1, KEY_CHARS))
    ordered = ordered.sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    ordered.mapInArrow(encode, "seq bigint, payload binary").write.parquet(path)
    return ranges


def read_documents(shards: DataFrame) -> DataFrame:
    """``doc_id, file, seq, offset, n_tokens, ids_crc32`` of every document, from the shards alone.

    Shards are ordered by their range, whose number their file names carry, and their place in it.
    """
    schema = "doc_id bigint, file bigint, seq bigint, offset bigint, n_tokens bigint, ids_crc32 bigint"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, seq, payload in zip(batch["file"].to_pylist(), batch["seq"].to_pylist(), batch["payload"]):
                matrix = WaveletMatrix(payload.as_py())
                ids = memoryview(matrix.decode().astype("<u4", copy=False)).cast("B")
                ends = matrix.ends.astype(np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                sums = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                n = len(sums)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(matrix.doc_ids, pa.int64()),
                        pa.array([file] * n, pa.int64()),
                        pa.array([seq] * n, pa.int64()),
                        pa.array(starts),
                        pa.array(ends - starts),
                        pa.array(sums, pa.int64()),
                    ],
                    ["doc_id", "file", "seq", "offset", "n_tokens", "ids_crc32"],
                )

    number = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("bigint")
    files = shards.select(number.alias("file"), "seq", "payload")
    return files.mapInArrow(read, schema)


def token_table(docs: DataFrame, tokenizer: str, path: str | None = None, **options) -> DataFrame:
    """Write the shard files and give ``doc_id, start, n_tokens, ids_crc32`` as read back from them.

    The ids before each shard are summed over one row per shard, not per document.
    """
    spark = docs.sparkSession
    path = path or fresh_path(spark, "shards.parquet")
    write_shards(docs, tokenizer, path, **options)
    read = written(read_documents(spark.read.schema("seq bigint, payload binary").parquet(path)), "tokens")
    totals = read.groupBy("file", "seq").agg(F.sum("n_tokens").alias("n"))
    totals = running_sums(totals, ["file", "seq"], {"before": F.col("n")}).select("file", "seq", "before")
    return read.join(totals, ["file", "seq"]).select(
        "doc_id", (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"
    )
