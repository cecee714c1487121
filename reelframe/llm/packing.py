"""Best-fit packing of token sequences by bin completion over the histogram of piece lengths.

How pieces fit together depends on their lengths alone, and there are at most 4096 lengths.  The driver solves that bounded
problem: it fills each bin around the largest length left with an undominated filling, repeats the filling as often as the
counts allow, and searches other fillings (branch and bound, with best-fit solutions as incumbents) until the number of
sequences meets the lower bound or the node budget ends.  Executors then give each piece, by its rank among the pieces of
its length, a slot.  No text is shuffled, and the driver's work does not grow with the corpus.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

CAPACITY = 4096
END_ID = 1
#: Steps of the search for better packings than best fit.  They bound effort, not the rows that are packed.
STEPS = 200_000
#: Words a worker remembers; it forgets all when there are more.
CACHE = 500_000
#: Texts of a slice that is tokenized at once end with the first that takes it beyond so many bytes.
SLICE = 6_000_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

#: Letters that stay one letter each in NFC and in lower case, whatever ASCII follows.  U+0130 and letters that NFC takes
#: apart are not among them: what they leave behind would join the marks after it.
_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017e\u0391-\u03a1\u03a3-\u03a9\u03b1-\u03c9\u0410-\u044f"
#: ASCII marks without the apostrophe, which can begin a contraction, and without <, which can begin a special token's name.
_MARK = r"!-&(-/:;=-@\[-`{-~"


class _Ids:
    """Ids of texts, many at a time.

    The tokenizer lower-cases, drops white space and never joins across it, nor across the border from a letter to a mark.  So
    white space at such borders changes no id, and the ids of a text are those of its words in order.  Words that are all
    letters or all marks have one end-of-word id each, the last; they are encoded together, and the ends tell them apart.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {"": 0}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.start, self.size, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0

    def _encode(self, texts: list[str]) -> list[list[int]]:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [e.ids for e in encode(texts, add_special_tokens=False)]

    def _append(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        first, n = len(self.place), len(words)
        self.place.update(zip(words, range(first, first + n), strict=True))
        while len(self.flat) < self.used + len(ids):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.start) < first + n:
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[first : first + n] = self.used + np.cumsum(sizes) - sizes
        self.size[first : first + n] = sizes
        self.used += len(ids)

    def learn(self, words: pa.Array) -> None:
        """Adds words (no one known before) to the table."""
        plain = pc.match_substring_regex(words, f"^(?:[{_LETTER}]+|[{_MARK}]+)$")
        easy, odd = words.filter(plain).to_pylist(), words.filter(pc.invert(plain)).to_pylist()
        for low in range(0, len(easy), 4096):
            part = easy[low : low + 4096]
            ids = np.array(self._encode([" ".join(part)])[0], np.uint32)
            last = np.flatnonzero(self.ends[ids])
            if len(last) != len(part):  # a tokenizer without ends of words
                odd += part
                continue
            self._append(part, ids, np.diff(last, prepend=-1))
        for low in range(0, len(odd), 4096):
            part = odd[low : low + 4096]
            found = self._encode(part)
            self._append(part, np.array([i for ids in found for i in ids], np.uint32), np.fromiter(map(len, found), np.int64, len(found)))

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text)."""
        texts = pc.fill_null(texts, "")
        cut = pc.replace_substring_regex(pc.ascii_lower(texts), f"([{_LETTER}])([{_MARK}])", r"\1 \2")
        named = pc.match_substring(texts, "<|")
        if pc.any(named).as_py():  # names of special tokens count as written, and whole
            cut = pc.if_else(named, texts, cut)
        lists = pc.ascii_split_whitespace(cut)
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.place) + len(words) > CACHE:
            self.forget()
        at = [self.place.get(w, -1) for w in words]
        place = np.array(at, np.int64)
        if (new := np.flatnonzero(place < 0)).size:
            self.learn(coded.dictionary.take(pa.array(new)))
            place[new] = [self.place[words[i]] for i in new.tolist()]
        word = place[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
        sizes = self.size[word]
        after = np.cumsum(sizes)
        total = int(after[-1]) if len(after) else 0
        ids = self.flat[np.repeat(self.start[word] - after + sizes, sizes) + np.arange(total)]
        after = np.r_[0, after]
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
        return ids, np.diff(after[ends], prepend=0)


@lru_cache(2)
def _tokenizer(path: str) -> _Ids:
    """One table of words for all tasks of a worker."""
    return _Ids(path)


def _slices(texts: pa.Array):
    """(first, rows) of slices of at most 2048 texts that end with the text that takes them to SLICE bytes."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    low = 0
    while low < len(texts):
        before = sizes[low - 1] if low else 0
        high = min(low + 2048, int(np.searchsorted(sizes, before + SLICE)) + 1, len(texts))
        yield low, high - low
        low = high


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document's ids with the end id, cut only where longer than capacity."""
    path = tokenizer or default_tokenizer()
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        ids = _tokenizer(path)
        for batch in batches:
            for low, n in _slices(batch.column("text")):
                part = batch.slice(low, n)
                flat, sizes = ids.of(part.column("text"))
                flat, stop = flat.astype("<u4", copy=False), np.cumsum(sizes)
                count = -(-(sizes + 1) // capacity)
                row = np.repeat(np.arange(n), count)
                number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = number * capacity
                length = np.minimum(sizes[row] + 1 - start, capacity)
                a = (stop - sizes)[row] + start
                own = length - (number == count[row] - 1)  # without the end id
                data = memoryview(flat).cast("B")
                crcs = [zlib.crc32(data[4 * x : 4 * (x + k)]) for x, k in zip(a.tolist(), own.tolist(), strict=True)]
                crcs = [zlib.crc32(end, c) if k < m else c for c, k, m in zip(crcs, own.tolist(), length.tolist(), strict=True)]
                columns = [part.column("doc_id").take(pa.array(row)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def lower_bound(count: np.ndarray, capacity: int) -> int:
    """Martello and Toth's L2: no packing needs fewer bins."""
    size = np.arange(len(count))
    best = int(-(-(count * size).sum() // capacity))
    number, words = np.cumsum(count), np.cumsum(count * size)
    for k in range(0, capacity // 2 + 1):
        large = number[-1] - number[capacity - k]
        middle = number[capacity - k] - number[capacity // 2]
        free = middle * capacity - (words[capacity - k] - words[capacity // 2])
        small = words[capacity // 2] - (words[k - 1] if k else 0)
        best = max(best, int(large + middle + max(0, -(-(small - free) // capacity))))
    return best


def _bits(on: np.ndarray) -> int:
    """An integer whose bit i tells on[i]."""
    return int.from_bytes(np.packbits(on, bitorder="little").tobytes(), "little")


def _sums(chosen: list[tuple[int, int]], limit: int) -> tuple[int, int]:
    """Bits of the sums that some chosen pieces have, and of those that two or more have."""
    some, several, mask = 1, 0, (1 << limit + 1) - 1
    for length, times in chosen:
        step = 1
        while times > 0:
            n = min(step, times)
            shifted = some << length * n
            several |= (several << length * n | (shifted if n > 1 else shifted & ~(1 << length))) & mask
            some |= shifted & mask
            times, step = times - n, 2 * step
    return some, several


def dominated(chosen: list[tuple[int, int]], rest: int, others: int, room: int) -> bool:
    """True if a piece left out (bits of others) could stand for chosen pieces that are together as long, if they are
    several, or up to rest shorter: whatever it replaces fits wherever it was, so the filling with it is at least as good."""
    some, several = _sums(chosen, room)
    if several & others:
        return True
    longer, width = some << 1, 1  # lengths 1 to width beyond a sum
    while width < rest:
        step = min(width, rest - width)
        longer |= longer << step
        width += step
    return rest > 0 and bool(longer & others)


def fillings(left: np.ndarray, room: int, waste: int | None = None, effort: list[int] | None = None, top: int | None = None):
    """Yields the undominated fillings of room with lengths that remain, as ((length, times), ...), longest lengths first.

    A piece that fills what is left dominates every other way to go on.  A branch ends where all shorter pieces together
    could not bring its waste down to the bound.  effort, if given, holds the steps that may still be taken.  One piece of
    length top, if given, is taken already.  Between two fillings nothing as long as left is held: left may change in place,
    if it is as before when the next one is asked for.
    """
    waste = room if waste is None else waste
    effort = [1 << 60] if effort is None else effort
    remain = lambda n: int(left[n]) - (n == top)
    held: list[tuple] = []

    def tables():
        """Lengths that remain up to room, their counts, the words of all up to each, and their bits."""
        if not held:
            part = left[: room + 1].copy()
            if top is not None and top <= room:
                part[top] -= 1
            part[0] = 0
            have = np.flatnonzero(part)
            counts = part[have]
            held.append((have.tolist(), counts.tolist(), np.cumsum(have * counts).tolist(), _bits(part > 0)))
        return held[0]

    def others(chosen):
        return tables()[3] & ~sum(1 << n for n, t in chosen if t >= remain(n))

    def grow(rest: int, top: int, chosen: list):
        """Fillings of rest with lengths[:top]."""
        effort[0] -= 1
        if effort[0] < 0:
            return
        if not rest:
            if not dominated(chosen, 0, others(chosen), room):
                held.clear()
                yield tuple(chosen)
            return
        lengths = tables()[0]
        high = bisect_right(lengths, rest, 0, top)
        if high and lengths[high - 1] == rest:
            last = [*chosen, (rest, 1)]
            if not dominated(last, 0, others(last), room):
                del lengths
                held.clear()
                yield tuple(last)
            return
        if not high:
            if rest <= waste and not dominated(chosen, rest, others(chosen), room):
                del lengths
                held.clear()
                yield tuple(chosen)
            return
        del lengths
        for at in range(high - 1, -1, -1):
            lengths, counts, words, _ = tables()
            length, most = lengths[at], min(counts[at], rest // lengths[at])
            if rest - words[at] > waste:
                return
            del lengths, counts, words, _
            for times in range(most, 0, -1):
                yield from grow(rest - times * length, at, [*chosen, (length, times)])
                if effort[0] < 0:
                    return

    yield from grow(room, len(tables()[0]), [])


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over the histogram, as (lengths of a bin, times): the first incumbent."""
    left, done = left.copy(), []
    for top in range(len(left) - 1, 0, -1):
        while left[top] > 0:
            chosen, rest, use = [top], capacity - top, np.zeros(len(left), np.int64)
            use[top] = 1
            while rest > 0:
                fit = np.flatnonzero(left[: min(rest, top) + 1] > use[: min(rest, top) + 1])
                if not len(fit) or not fit[-1]:
                    break
                length = int(fit[-1])
                times = int(min(rest // length, left[length] - use[length]))
                chosen += [length] * times
                use[length] += times
                rest -= length * times
            on = use > 0
            times = int((left[on] // use[on]).min())
            left -= use * times
            done.append((tuple(chosen), times))
    return done


def complete(count: np.ndarray, capacity: int = CAPACITY, steps: int = STEPS) -> tuple[list[tuple[tuple[int, ...], int]], int, bool]:
    """(patterns as (lengths of a bin, times), lower bound, whether surely no packing has fewer bins).

    Branch and bound by bin completion: a node is the largest length left, its branches are the undominated fillings around
    it, and the waste that an improved packing may have bounds them.  The first branch is repeated as often as the counts
    allow, others are taken once.  Each round allows one more swerve from the first branch than the round before.  The search
    ends when the lower bound is met, when a round has left nothing out, or when its steps are spent.
    """
    bound = lower_bound(count, capacity)
    best = best_fit(count, capacity)
    words = int((np.arange(len(count)) * count).sum())
    fewest = sum(n for _, n in best)
    effort, cut = [steps], False
    allowed = lambda: (fewest - 1) * capacity - words  # noqa: E731  waste of a packing with one bin less

    left = count.copy()  # of the node at hand: changed in place on the way down, restored on the way back

    def branches(top: int, waste: int, swerves: int):
        """(filling, times, swerves left) of a node."""
        nonlocal cut
        ways = fillings(left, capacity - top, waste, effort, top)
        filling = next(ways, None)
        if filling is None:
            return
        use = dict(filling)
        use[top] = use.get(top, 0) + 1
        times = int(min(left[n] // t for n, t in use.items()))
        cut = cut or times > 1 and not swerves
        if cut and not swerves:
            ways = iter(())  # there is something to leave out already, and no other way may be taken
        yield filling, times, swerves
        if times > 1 and swerves:
            yield filling, 1, swerves - 1
        for filling in ways:
            if not swerves:
                cut = True
                return
            yield filling, 1, swerves - 1

    def search(swerves: int) -> None:
        """Depth first; a level holds its place among its branches, not the lengths left."""
        nonlocal best, fewest
        done: list[tuple[int, tuple, int]] = []
        stack: list[tuple] = []

        def take(step: tuple[int, tuple, int], sign: int) -> None:
            top, filling, times = step
            for n, t in ((top, 1), *filling):
                left[n] -= sign * t * times

        def push(waste: int, used: int, swerves: int) -> None:
            nonlocal best, fewest
            on = np.flatnonzero(left > 0)
            if len(on):
                stack.append((waste, used, int(on[-1]), branches(int(on[-1]), allowed() - waste, swerves)))
            elif used < fewest:
                best, fewest = [((t, *(n for n, k in f for _ in range(k))), m) for t, f, m in done], used

        push(0, 0, swerves)
        while stack:
            waste, used, top, ways = stack[-1]
            while len(done) >= len(stack):
                take(done.pop(), -1)
            found = next(ways, None) if fewest > bound and effort[0] >= 0 else None
            if found is None:
                stack.pop()
                continue
            filling, times, rest = found
            more = waste + times * (capacity - top - sum(n * t for n, t in filling))
            if more > allowed():
                continue
            done.append((top, filling, times))
            take(done[-1], 1)
            push(more, used + times, rest)
        while done:
            take(done.pop(), -1)

    swerves = 0
    while fewest > bound and effort[0] >= 0:
        cut = False
        search(swerves)
        if not cut:
            break
        swerves += 1
    return best, bound, fewest == bound or effort[0] >= 0


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Slot ranges in order of (length, first rank): first rank, pieces of that length per bin, first sequence and offsets."""
    rows, sequence, ranks = [], 0, {}
    for lengths, times in patterns:
        offset, places = 0, {}
        for length in lengths:
            places.setdefault(length, []).append(offset)
            offset += length
        for length, offsets in places.items():
            first = ranks.get(length, 0)
            rows.append((length, first, sequence, offsets))
            ranks[length] = first + times * len(offsets)
        sequence += times
    rows.sort(key=lambda r: r[:2])
    per = np.array([len(r[3]) for r in rows], np.int64)
    return {
        "key": np.array([r[0] << 48 | r[1] for r in rows], np.int64),
        "sequence": np.array([r[2] for r in rows], np.int64),
        "per": per,
        "at": np.cumsum(per) - per,
        "offsets": np.array([o for r in rows for o in r[3]], np.int64),
    }


def pack_pieces(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut with sequence_id and offset.  cut must be stored: it is read for the histogram, the ranks and the result."""
    spark = cut.sparkSession
    counted = cut.groupBy("length").count().collect()  # at most capacity rows
    count = np.zeros(capacity + 1, np.int64)
    for row in counted:
        count[row["length"]] = row["count"]
    sent = spark.sparkContext.broadcast(slots(complete(count, capacity)[0]))
    # Ranks within a length by two levels, so that no length, however common, is ordered in one task.
    buckets = max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy("length", "bucket").count()
    before = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    own = W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("own", F.row_number().over(own) - 1).join(sizes, ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("own")).alias("rank"))

    def place(batches):
        s = sent.value
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            if not len(length):
                continue
            at = np.searchsorted(s["key"], length << 48 | rank, side="right") - 1
            turn = rank - (s["key"][at] & (1 << 48) - 1)
            sequence = s["sequence"][at] + turn // s["per"][at]
            offset = s["offsets"][s["at"][at] + turn % s["per"][at]]
            columns = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset per piece of every document.

    Null and empty texts are the end id alone; repeated rows are packed each; equal rows are interchangeable; a null
    doc_id stays null; an empty table gives no rows; other columns are not read.
    """
    return pack_pieces(materialize(pieces(docs, tokenizer, capacity), "pieces"), capacity)
