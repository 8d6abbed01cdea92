"""Lexical retrieval packing of documents into fixed-length token sequences.

Documents are tokenised once. Whole windows of long documents are sequences of their own; what is left
of every document is packed in shards of about ``SHARD_TOKENS`` tokens. Shards are ranges of a lexical
key (smallest token hashes, then the row), so that likely neighbours share a shard and no key can fill
one. Document frequencies, number of pieces and mean length are those of the whole table (a row a token
id, whatever the size of the table). In a shard a BM25 inverted index over token ids ranks the unused
neighbours of each seed document by all its terms; they fill its window in that order, and the one that
does not fit is cut. Retrieval does not leave the shard. The last window of a shard is cut at powers of two,
so that no sequence needs padding.

Defined results of the edge cases: null and empty texts are the end token alone; repeated rows are
packed each; very long texts are cut into windows; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.llm import kernels as K
from loomtrace.llm.storage import materialise

LENGTH = 4096
END = 2
SHARD_TOKENS = 2_000_000
#: BM25 constants, and the share of a shard's pieces from which a term's weights are kept for all pieces.
K1, B = 1.2, 0.75
DENSE = 1 / 16
#: Distinct chunks of text whose ids a worker remembers (some 50 bytes each), bits of a slot's number, and words of a line.
MEMORY, SLOT_BITS, LINE = 600_000, 21, 256

TOKENS = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("doc_tokens", pa.int64()), ("length", pa.int64()), ("key_a", pa.int64()), ("key_b", pa.int64()), ("ids", pa.binary())]
)
FREQUENCIES = pa.schema([("term", pa.int64()), ("pieces", pa.int64())])
PACKED = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())]
)


class Encoder:
    """Ids of texts, put together from remembered ids of their chunks.

    The vocabulary's pre-tokeniser never joins text across white space, nor a run of letters with the
    punctuation behind it, so that the ids of a text are those of its chunks in order. Chunks are found by
    a hash and compared byte by byte with the one remembered; those not remembered yet are encoded in lines.
    Lower-case Latin letters need no normalisation and are one word each: they go to the same model without it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.letters = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.letters.normalizer = None
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        # ids in the order of their hashes: the lexical keys of a text are the smallest of its ids
        mixed = K.mix(np.arange(len(self.ends), dtype=np.uint64)) >> np.uint64(1)
        self.mixed = np.sort(mixed)
        self.rank = np.searchsorted(self.mixed, mixed).astype(np.uint16 if len(mixed) < 1 << 16 else np.uint32)
        self.forget()

    def forget(self) -> None:
        """Keeps the chunks that were met again after their batch, or none if these are many too."""
        kept = np.flatnonzero(self.again) if hasattr(self, "again") else np.zeros(0, np.int64)
        if len(kept) > MEMORY // 2 or not len(kept):
            # bytes and ids of entry i are text[text_at[i] : text_at[i + 1]] and ids[ids_at[i] : ids_at[i + 1]]
            self.text, self.ids = np.zeros(0, np.uint8), np.zeros(0, self.kind)
            self.text_at, self.ids_at = np.zeros(1, np.int64), np.zeros(1, np.int64)
            hashes = np.zeros(0, np.uint64)
        else:
            hashes = self.hash_of[kept]
            self.text, self.text_at = _gathered(self.text, self.text_at[kept], self.text_at[kept + 1])
            self.ids, self.ids_at = _gathered(self.ids, self.ids_at[kept], self.ids_at[kept + 1])
        self.parts: dict[str, bytes] = {"": b""}
        self.again, self.hash_of = np.zeros(0, bool), np.zeros(0, np.uint64)
        # an entry is found in its slot, or among all hashes if another one was there first
        self.slots = np.full(1 << SLOT_BITS, -1, np.int32)
        self.hashes, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.enter(hashes)

    def enter(self, hashes: np.ndarray) -> None:
        """Hashes of the next entries."""
        entry = np.arange(len(self.hash_of), len(self.hash_of) + len(hashes), dtype=np.int32)
        self.hash_of = np.concatenate([self.hash_of, hashes])
        self.again = np.concatenate([self.again, np.zeros(len(hashes), bool)])
        order = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[order])
        self.hashes, self.entry = np.insert(self.hashes, at, hashes[order]), np.insert(self.entry, at, entry[order])
        slot = (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        free = self.slots[slot] < 0
        self.slots[slot[free]] = entry[free]

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def runs(self, text: np.ndarray, at: np.ndarray, tokenizer) -> tuple[np.ndarray, np.ndarray]:
        """Ids and number of ids of words that are one run each: encoded in lines and cut behind the ids that end a word."""
        n, ids, sizes = len(at) - 1, [np.zeros(0, self.kind)], [np.zeros(0, np.int64)]
        spaced = np.full(len(text) + n, 32, np.uint8)
        spaced[np.arange(len(text)) + np.repeat(np.arange(n), np.diff(at))] = text
        raw, at = spaced.tobytes(), (at + np.arange(n + 1)).tolist()
        for k in range(0, n, LINE):
            m = min(k + LINE, n)
            own = np.array(tokenizer.encode_batch_fast([raw[at[k] : at[m] - 1].decode()], add_special_tokens=False)[0].ids, self.kind)
            ends = np.flatnonzero(self.ends[own]) + 1
            if len(ends) == m - k:
                size = np.diff(ends, prepend=0)
            else:  # normalisation broke a run
                coded = self.whole([raw[at[j] : at[j + 1] - 1].decode() for j in range(k, m)])
                own, size = np.frombuffer(b"".join(coded), self.kind), np.array([len(c) // self.kind.itemsize for c in coded])
            ids.append(own)
            sizes.append(size)
        return np.concatenate(ids), np.concatenate(sizes)

    def learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, plain: np.ndarray) -> np.ndarray:
        """Remembers the ids of new chunks, ``plain`` ones (lower-case Latin letters) first; the number of each."""
        order = np.argsort(~plain, kind="stable")
        first, n_plain = len(self.hash_of), int(plain.sum())
        text, at = _gathered(data, starts[order], ends[order])
        ids, sizes = self.runs(text[: at[n_plain]], at[: n_plain + 1], self.letters)
        raw, cut = text.tobytes(), at[n_plain:].tolist()
        others = self.others([raw[b:e].decode() for b, e in zip(cut[:-1], cut[1:], strict=True)])
        more = np.array([len(c) // self.kind.itemsize for c in others], np.int64)
        self.text, self.text_at = np.concatenate([self.text, text]), np.concatenate([self.text_at, self.text_at[-1] + at[1:]])
        self.ids = np.concatenate([self.ids, ids, np.frombuffer(b"".join(others), self.kind)])
        self.ids_at = np.concatenate([self.ids_at, self.ids_at[-1] + np.cumsum(np.concatenate([sizes, more]))])
        self.enter(hashes[order])
        number = np.empty(len(order), np.int32)
        number[order] = np.arange(first, first + len(order))
        return number

    def others(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks that are not plain: letters of any script are cut from the punctuation behind them."""
        split = [_cut(chunk) for chunk in chunks]
        new = list({part for cut in split if len(cut) == 2 for part in cut if part not in self.parts})
        if new:
            raw = [part.encode() for part in new]
            ids, sizes = self.runs(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]), self.tokenizer)
            data, ends = ids.tobytes(), (np.cumsum(sizes) * self.kind.itemsize).tolist()
            self.parts.update(zip(new, (data[b:e] for b, e in zip([0, *ends], ends, strict=False)), strict=True))
        odd = iter(self.whole([cut[0] for cut in split if len(cut) != 2]))
        return [self.parts[cut[0]] + self.parts[cut[1]] if len(cut) == 2 else next(odd) for cut in split]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts behind each other, and where each begins."""
        if len(self.hash_of) > MEMORY:
            self.forget()
        data, offsets = K.text_buffer(texts)
        data, starts, ends, rows, plain = _parts(data, *K.words(data, offsets, K.SPACE_SEPARATED))
        hashes = K.word_hashes(data, starts, ends, lower=False)
        entry = self.slots[(hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
        known = len(self.hash_of)
        missed = np.flatnonzero((entry < 0) | (self.hash_of[entry] != hashes)) if known else np.arange(len(hashes))
        if len(missed):
            distinct, first, inverse = np.unique(hashes[missed], return_index=True, return_inverse=True)
            at = np.minimum(np.searchsorted(self.hashes, distinct), max(known - 1, 0))
            new = np.flatnonzero(self.hashes[at] != distinct) if known else np.arange(len(distinct))
            number = self.entry[at] if known else np.zeros(len(distinct), np.int32)
            if len(new):
                chosen = missed[first[new]]
                number[new] = self.learn(data, starts[chosen], ends[chosen], distinct[new], plain[chosen])
            entry[missed] = number[inverse]
        self.again[entry[entry < known]] = True
        if not self._same(data, starts, ends, entry):
            coded = self.whole([t or "" for t in texts.to_pylist()])
            return np.frombuffer(b"".join(coded), self.kind), np.concatenate([[0], np.cumsum([len(c) // self.kind.itemsize for c in coded])])
        ids, before = _gathered(self.ids, self.ids_at[entry], self.ids_at[entry + 1])
        return ids, before[np.searchsorted(rows, np.arange(len(offsets)))]

    def _same(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, entry: np.ndarray) -> bool:
        """Whether every chunk is, byte by byte, the one that is remembered under its hash."""
        begin, size = self.text_at[entry], ends - starts
        if not np.array_equal(size, self.text_at[entry + 1] - begin):
            return False
        before = np.cumsum(size) - size
        place = np.arange(size.sum())
        return bool(np.array_equal(data[np.repeat(starts - before, size) + place], self.text[np.repeat(begin - before, size) + place]))


def _gathered(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans behind each other, and their borders."""
    size = ends - starts
    at = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
    return values[np.repeat(starts - at[:-1], size) + np.arange(at[-1])], at


def _parts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """Chunks of Latin letters with ASCII punctuation behind as two chunks each, their letters in lower case.

    Returns the bytes, starts, ends, rows, and which chunks are letters only.
    """
    if not len(starts):
        return data, starts, ends, rows, np.zeros(0, bool)
    lowered, odd = K.LOWER[data], np.flatnonzero(_ODD[data])
    kind = _ODD[data[odd]]
    # U+00C0 to U+00FF are the bytes C3, 80 to BF: all letters but two signs, those from C3 A0 in lower case
    lead = np.flatnonzero(data[odd] == 0xC3)
    second = data[odd[lead] + 1]
    lead = lead[(second != 0x97) & (second != 0xB7)]
    second = odd[lead] + 1
    lowered[second] = np.where((data[second] < 0xA0) & (data[second] != 0x9F), data[second] + 0x20, data[second])
    kind[lead] = kind[lead + 1] = 0
    odd, kind = odd[kind > 0], kind[kind > 0]
    # a chunk's bytes that are no letters: it is cut before them if they are its end, and punctuation
    chunk = np.searchsorted(starts, odd, "right") - 1
    first = np.flatnonzero(np.diff(chunk, prepend=-1))
    has, at = chunk[first], odd[first]
    count = np.diff(np.append(first, len(odd)))
    other = np.bincount(chunk[kind == 2], minlength=len(starts))[has] > 0
    cut = ~other & (at > starts[has]) & (at == ends[has] - count)
    plain, body = np.ones(len(starts), bool), ends.copy()
    plain[has[~cut]] = False
    body[has[cut]] = at[cut]
    # what isn't plain keeps its case
    kept = np.flatnonzero(~plain)
    size = ends[kept] - starts[kept]
    place = np.repeat(starts[kept] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    lowered[place] = data[place]
    tail = body < ends
    first = np.arange(len(starts)) + np.cumsum(tail) - tail
    n = len(starts) + int(tail.sum())
    out = [np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, np.int64), np.zeros(n, bool)]
    for column, own, behind in zip(out, (starts, body, rows, plain), (body, ends, rows, np.zeros(len(starts), bool)), strict=True):
        column[first] = own
        column[first[tail] + 1] = behind[tail]
    return lowered, *out


_PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: 0 for white space and ASCII letters, 1 for punctuation that ends a run of letters, 2 for other bytes.
_ODD = np.full(256, 2, np.uint8)
_ODD[[0x20, *range(0x09, 0x0E), *range(65, 91), *range(97, 123)]] = 0
_ODD[list(_PUNCTUATION.encode())] = 1


def _cut(chunk: str) -> tuple[str, ...]:
    """A run of letters and the ASCII punctuation behind it (or nothing), else the chunk alone."""
    body = chunk.rstrip(_PUNCTUATION)
    low = body.lower()
    if body.isalpha() and low.isalpha():
        return (low if body.isascii() else body), chunk[len(body) :]
    return (chunk,)


#: One encoder for each vocabulary and worker process: what it remembers serves later tasks too.
_ENCODERS: dict[str, Encoder] = {}


def tokenise(documents: DataFrame, vocabulary: str) -> DataFrame:
    """Windows and remainders of all documents with their ids and lexical keys (``TOKENS``)."""
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = _ENCODERS.get(vocabulary) or Encoder(vocabulary)
        _ENCODERS[vocabulary] = encoder
        for batch in K.chunks(batches, "text"):
            ids, at = encoder.encode(batch.column(1))
            ids = np.insert(ids, at[1:], END)
            at = at + np.arange(len(at))
            size = np.diff(at)
            # windows of each document
            count = -(-size // LENGTH)
            doc = np.repeat(np.arange(len(size)), count)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * LENGTH
            begin = at[doc] + start
            length = np.minimum(size[doc] - start, LENGTH)
            low, second = (encoder.mixed[r].view(np.int64) for r in _two_smallest(encoder.rank[ids], begin))
            borders = (np.append(begin, len(ids)) * ids.itemsize).astype(np.int32)
            pieces = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(borders), pa.py_buffer(ids)])
            columns = [batch.column(0).take(pa.array(doc)), pa.array(start), pa.array(size[doc]), pa.array(length), pa.array(low), pa.array(second), pieces]
            yield pa.RecordBatch.from_arrays(columns, schema=TOKENS)

    return K.map_arrow(source, run, TOKENS)


def _two_smallest(values: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest and the next different value of each run; a run of one value has it twice."""
    low = np.minimum.reduceat(values, begin)
    length = np.diff(np.append(begin, len(values)))
    most = np.iinfo(values.dtype).max
    second = np.minimum.reduceat(np.where(values == np.repeat(low, length), most, values), begin)
    return low, np.where(second == most, low, second)


def statistics(rest: DataFrame, kind: str) -> tuple[np.ndarray, int, float]:
    """Pieces that have each token id, number of pieces, and mean length, over the whole table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: np.ndarray = np.zeros(0, np.int64)
        for batch in batches:
            ids, size = _flat(batch.column(0), kind)
            span = int(ids.max(initial=0)) + 1
            # 32 bits are sorted faster, where they hold a piece and a term
            wide = np.uint32 if len(size) * span < 1 << 32 else np.uint64
            keys = np.sort(np.repeat(np.arange(len(size), dtype=wide) * wide(span), size) + ids.astype(wide))
            terms = keys[np.append(keys[:-1] != keys[1:], True)[: len(keys)]] % wide(span)
            df = _added(df, np.bincount(terms.astype(np.int64), minlength=span))
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(df[seen])], schema=FREQUENCIES)

    sums = rest.agg(F.count(F.lit(1)), F.sum("length")).first()
    rows = K.map_arrow(rest.select("ids"), run, FREQUENCIES).groupBy("term").agg(F.sum("pieces").alias("pieces")).collect()
    df = np.zeros(max((r[0] for r in rows), default=0) + 1, np.int64)
    for term, pieces in rows:
        df[term] = pieces
    return df, int(sums[0]), int(sums[1] or 0) / max(int(sums[0]), 1)


def _added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros(max(len(a), len(b)), np.int64)
    out[: len(a)] += a
    out[: len(b)] += b
    return out


def _flat(pieces: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of some pieces, and the number of ids of each."""
    width, size = np.dtype(kind).itemsize, pc.binary_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.frombuffer(b"".join(pieces.to_pylist()), kind), size // width


class Shard:
    """BM25 postings over the token ids of one shard, and what is still unused of each piece.

    ``df``, ``total`` and ``mean`` are the statistics of the whole table.
    """

    def __init__(self, pieces: list[np.ndarray], df: np.ndarray, total: int, mean: float):
        self.at = np.zeros(len(pieces), np.int64)
        self.left = np.array([len(p) for p in pieces], np.int64)
        flat = np.concatenate(pieces).astype(np.int64)
        span = int(flat.max()) + 1
        keys, tf = np.unique(flat + np.repeat(np.arange(len(pieces)), self.left) * span, return_counts=True)
        row, term = keys // span, keys % span
        known = df[term]
        idf = np.log(1 + (total - known + 0.5) / (known + 0.5))
        weight = (idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * self.left[row] / max(mean, 1e-9)))).astype(np.float32)
        self.first, self.count = K.run_starts(row, len(pieces))
        self.term = term
        here = np.bincount(term, minlength=span)
        by_term = np.argsort(term, kind="stable")
        self.row, self.weight = row[by_term], weight[by_term]
        self.posting = np.concatenate([[0], np.cumsum(here)])
        # a frequent term's weights are a row over all pieces, so that adding them up needs no index
        frequent = np.flatnonzero(here > DENSE * len(pieces))
        self.dense_of = np.full(span, -1)
        self.dense_of[frequent] = np.arange(len(frequent))
        self.dense = np.zeros((len(frequent), len(pieces)), np.float32)
        inside = self.dense_of[term] >= 0
        self.dense[self.dense_of[term[inside]], row[inside]] = weight[inside]

    def neighbours(self, seed: int, tokens: int) -> np.ndarray:
        """Unused pieces by falling BM25 score against all the seed's terms, then by row: enough for ``tokens`` tokens."""
        terms = self.term[self.first[seed] : self.first[seed] + self.count[seed]]
        place = self.dense_of[terms]
        scores = self.dense[place[place >= 0]].sum(axis=0, dtype=np.float64)
        slices = [slice(self.posting[t], self.posting[t + 1]) for t in terms[place < 0]]
        if slices:
            rows = np.concatenate([self.row[s] for s in slices])
            scores += np.bincount(rows, np.concatenate([self.weight[s] for s in slices]), len(self.left))
        some = np.flatnonzero(self.left)
        some = some[some != seed]
        best = 64
        while best < len(some):
            chosen = some[scores[some] >= np.partition(scores[some], len(some) - best)[len(some) - best]]
            if self.left[chosen].sum() >= tokens:
                some = chosen
                break
            best *= 4
        return some[np.lexsort((some, -scores[some]))]

    def take(self, row: int, n: int) -> tuple[int, int, int]:
        """(row, start in the piece, length) of the next ``n`` unused tokens of a piece."""
        begin = int(self.at[row])
        self.at[row] += n
        self.left[row] -= n
        return row, begin, n

    def sequences(self) -> Iterator[list[tuple[int, int, int]]]:
        """Windows of exactly ``LENGTH`` tokens as long as there are enough, then powers of two."""
        unused = int(self.left.sum())
        for seed in range(len(self.left)):
            while self.left[seed] and unused >= LENGTH:
                window = [self.take(seed, int(min(self.left[seed], LENGTH)))]
                room = LENGTH - window[0][2]
                for row in self.neighbours(seed, room).tolist() if room else ():
                    window.append(self.take(row, int(min(room, self.left[row]))))
                    room -= window[-1][2]
                    if not room:
                        break
                unused -= LENGTH
                yield window
        rest = [r for r in range(len(self.left)) if self.left[r]]
        while rest:
            room = 1 << (int(self.left.sum()).bit_length() - 1)
            window = []
            while room:
                if not self.left[rest[0]]:
                    rest.pop(0)
                    continue
                window.append(self.take(rest[0], int(min(room, self.left[rest[0]]))))
                room -= window[-1][2]
            rest = [r for r in rest if self.left[r]]
            yield window


def pack(documents: DataFrame, vocabulary: str) -> DataFrame:
    """All documents' pieces with their ids, sequence and offset (``PACKED``; ids unsigned 32-bit)."""
    from tokenizers import Tokenizer

    kind = "<u2" if Tokenizer.from_file(vocabulary).get_vocab_size() <= 1 << 16 else "<u4"
    tokens = materialise(tokenise(documents, vocabulary), "tokens")
    rest = tokens.where(F.col("length") < LENGTH)
    df, n_pieces, mean = statistics(rest, kind)
    shards = max(1, -(-int(n_pieces * mean) // SHARD_TOKENS))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held = [(d, s, n, np.frombuffer(i, kind)) for b in batches for d, s, n, i in zip(*(b.column(k).to_pylist() for k in (0, 1, 2, 6)), strict=True)]
        rows: list[dict] = []
        for number, window in enumerate(Shard([h[3] for h in held], df, n_pieces, mean).sequences() if held else ()):
            offset = 0
            for row, begin, n in window:
                doc, start, whole, ids = held[row]
                rows.append({"doc_id": doc, "start": start + begin, "length": n, "doc_tokens": whole, "sequence_id": (part << 32) + number, "offset": offset, "ids": ids[begin : begin + n].astype("<u4").tobytes()})
                offset += n
            if len(rows) >= 512:
                yield pa.RecordBatch.from_pylist(rows, PACKED)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, PACKED)

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.frombuffer(i, kind).astype("<u4").tobytes() for i in b.column(5).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), b.column(4), pa.array([0] * b.num_rows, pa.int64()), pa.array(ids, pa.binary())], schema=PACKED)

    own = (F.monotonically_increasing_id() + F.lit(1 << 62)).alias("sequence_id")
    windows = tokens.where(F.col("length") == LENGTH).select("doc_id", "start", "length", "doc_tokens", own, "ids")
    # in one order, so that a shard is packed alike when a lost executor's work is done again
    order = ["key_a", "key_b", "doc_id", "start", "ids"]
    sharded = rest.repartitionByRange(shards, *order[:-1]).sortWithinPartitions(*order)
    return K.map_arrow(windows, widen, PACKED).unionByName(K.map_arrow(sharded, fill, PACKED))
