"""Brown class-based bigrams: exchange clustering of words, class transitions and word emissions, smoothed.

Every word of the training documents gets its class from its own neighbours, whatever the vocabulary's size:
1. Words are counted, and the counts staged as a table of any size.
2. The OWN_WORDS most frequent words are clustered by exchange (Martin et al., 1998): one word after the other moves to
   the class that raises the class bigrams' likelihood most, until no word gains. What this works on is a matrix of
   OWN_WORDS rows, so one task holds it whatever the corpus is. A class gains by log(number of its words) besides, as in
   a Chinese restaurant process: a word of little evidence joins the many instead of fitting its few neighbours.
3. The next words, up to SENT_WORDS in all, are placed: the classes to the left and right of all their occurrences are
   summed per word, and each goes where the likelihood rises most; in a second sweep, with all these classes known, each moves once more.
4. All other words are placed in the same way, as a table of any size, from the final classes of the words around them.
Words to which 3 and 4 come are rare: the most frequent one has a share of 1 / OWN_WORDS of the tokens at most, so no
word's occurrences are too many for a task.

Scores: the classes and counts of the SENT_WORDS go to the tasks; of the other words a document's occurrences are
joined to their table, with the classes beside them. An unseen word may be of any class: its probability is the sum over
the classes' smoothing, and what follows it has the classes' own shares.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkframe.llm import common

FOLDS = 10
SMOOTHING = 0.1
#: Words that the exchange clusters one after the other.
OWN_WORDS = 4096
CLASSES = 64
#: Sweeps of the exchange; it ends before them when no word gains.
MOST_SWEEPS = 200
LEAST_GAIN = 1e-6
TRANSITION_SMOOTHING = 0.5
#: Words whose counts and classes are sent to the tasks, at most (all of a count or none); those of others are joined.
SENT_WORDS = 300_000
#: Tokens of a task that are combined before they are shuffled.
COMBINED = 4_000_000

#: The end token's class; one more stands for words whose class is not known in a task.
END_CLASS = CLASSES
SIDE = CLASSES + 1
#: In the transitions, unseen words.
UNSEEN = SIDE


def held_out(id_col: str) -> F.Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def tokens(text: bytes) -> list[bytes]:
    """The words; the end token is not among them."""
    return text.lower().split()


class _Index(dict):
    """word -> its number; -1 for words that are not in it."""

    def __missing__(self, word: bytes) -> int:
        return -1


def count_words(train: DataFrame) -> DataFrame:
    """train: text. (word, c) of all its words."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: Counter[bytes] = Counter()
        for text in common.text_bytes(batch.column("text")):
            found.update(tokens(text))
        return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], names=["word", "c"])

    return common.map_batches(train, count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def numbered(docs: DataFrame, index: _Index) -> DataFrame:
    """docs with the text, the last column, as ids (its words' numbers as 32-bit integers, -1 for words that have none) and cold (those words,
    in order), staged: texts are cut into words and looked up once, and all later steps read numbers."""
    sent = docs.sparkSession.sparkContext.broadcast(index)  # at most SENT_WORDS
    carried = docs.columns[:-1]

    def number(batch: pa.RecordBatch) -> pa.RecordBatch:
        lookup, ids, cold, sizes = sent.value, [], [], [0]
        for text in common.text_bytes(batch.column(batch.num_columns - 1)):
            mine = tokens(text)
            at = [lookup[w] for w in mine]
            if -1 in at:
                cold += [w for w, i in zip(mine, at, strict=True) if i < 0]
            sizes.append(len(cold))
            ids.append(np.array(at, np.int32).tobytes())
        words = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(cold, pa.binary()))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(ids, pa.binary()), words], names=[*carried, "ids", "cold"])

    kinds = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in carried)
    return common.stage(common.map_batches(docs, number, f"{kinds}ids binary, cold array<binary>"), "numbers", "zstd")


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all of a batch's words in one array, and how many each text has."""
    column = batch.column("ids")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.int32, (offsets[-1] - offsets[0]) // 4, offsets[0]) if data is not None and offsets[-1] > offsets[0] else np.empty(0, np.int32)
    return flat, np.diff(offsets) // 4


def _runs(batches: Iterator[pa.RecordBatch], end: int) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Of rows of numbered(): numbers of the words of many texts, an end before, between and after them, and those words that have none, in order."""
    rows, cold, size = [np.array([end], np.int64)], [], 1
    for batch in batches:
        if not batch.num_rows:
            continue
        flat, lens = _flat(batch)
        row = np.full(len(flat) + len(lens), end, np.int64)
        row[np.arange(len(flat)) + np.repeat(np.arange(len(lens)), lens)] = flat
        rows.append(row)
        cold += pc.list_flatten(batch.column("cold")).to_pylist()
        size += len(row)
        if size > COMBINED:
            yield np.concatenate(rows), cold
            rows, cold, size = [np.array([end], np.int64)], [], 1
    if size > 1:
        yield np.concatenate(rows), cold


def count_pairs(train: DataFrame, own: int, end: int) -> DataFrame:
    """train: numbered(), end: the words' number. A row for each of the first `own` words and the end, which is the last: unit, and the
    own words that follow it with their counts."""
    size = own + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, _ in _runs(batches, end):
            at = np.where(at == end, own, np.where(at < own, at, -1))
            both = (at[:-1] >= 0) & (at[1:] >= 0)
            pair, n = np.unique(at[:-1][both] * size + at[1:][both], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair, pa.int64()), pa.array(n, pa.int64())], names=["pair", "n"])

    pairs = train.mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    pairs = pairs.select(F.floor(F.col("pair") / size).cast("int").alias("unit"), F.struct(F.pmod("pair", F.lit(size)).cast("int").alias("other"), "n").alias("x"))
    got = pairs.groupBy("unit").agg(F.collect_list("x").alias("x"))  # at most OWN_WORDS + 1 of them
    return got.select("unit", F.col("x.other").alias("other"), F.col("x.n").alias("n"))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def best_class(matrix: np.ndarray, now: int, left: np.ndarray, right: np.ndarray, own: float, prior: np.ndarray | float = 0.0) -> tuple[int, float]:
    """The class to which a unit should go, and the rise in likelihood that this gives; prior is added to the classes' gains."""
    m, n = matrix.copy(), right.sum()
    m[now] -= right
    m[:, now] -= left
    m[now, now] += own
    left, right = left.copy(), right.copy()
    left[now] -= own
    right[now] -= own
    diagonal, out, into = np.diag(m), matrix.sum(axis=1), matrix.sum(axis=0)
    out[now] -= n
    into[now] -= left.sum() + own
    gain = (_xlogx(m + right) - _xlogx(m)).sum(axis=1) + (_xlogx(m + left[:, None]) - _xlogx(m)).sum(axis=0)
    gain += _xlogx(diagonal + left + right + own) + _xlogx(diagonal) - _xlogx(diagonal + left) - _xlogx(diagonal + right)
    gain -= _xlogx(out + n) - _xlogx(out) + _xlogx(into + left.sum() + own) - _xlogx(into)
    gain = gain[:CLASSES] + prior
    to = int(gain.argmax())
    return to, float(gain[to] - gain[now])


def likelihood(matrix: np.ndarray) -> float:
    return float(_xlogx(matrix).sum() - _xlogx(matrix.sum(axis=1)).sum() - _xlogx(matrix.sum(axis=0)).sum())


def exchange(counts: np.ndarray, sweeps: int = MOST_SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """counts: how often each unit follows each; the last unit is the end, whose class is its own. A class for each unit,
    and the class bigram counts. Units move one after the other until none gains."""
    units = len(counts) - 1
    classes = np.append(np.arange(units) % CLASSES, END_CLASS)
    hot = np.zeros((units + 1, SIDE))
    hot[np.arange(units + 1), classes] = 1
    right, left = counts @ hot, counts.T @ hot
    matrix, words = hot.T @ right, np.bincount(classes[:units], minlength=CLASSES)
    for _ in range(sweeps):
        moved = 0
        for u in range(units):
            now = classes[u]
            own = float(counts[u, u])
            words[now] -= 1
            to, gain = best_class(matrix, now, left[u], right[u], own, np.log(words + 1))
            if gain <= LEAST_GAIN:
                words[now] += 1
                continue
            words[to] += 1
            matrix[now] -= right[u]
            matrix[to] += right[u]
            matrix[:, now] -= left[u]
            matrix[:, to] += left[u]
            # the unit beside itself: both of its ends move
            matrix[now, now] += own
            matrix[to, to] += own
            matrix[to, now] -= own
            matrix[now, to] -= own
            right[:, now] -= counts[:, u]
            right[:, to] += counts[:, u]
            left[:, now] -= counts[u]
            left[:, to] += counts[u]
            classes[u] = to
            moved += 1
        if not moved:
            break
    return classes, matrix


def cluster(pairs: DataFrame, units: int) -> tuple[np.ndarray, np.ndarray]:
    """exchange() in one task; pairs has units + 1 rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((units + 1, units + 1), np.float32)  # whole numbers, summed in doubles
        for batch in batches:
            for i in range(batch.num_rows):
                counts[batch.column("unit")[i].as_py(), batch.column("other")[i].values.to_numpy()] = batch.column("n")[i].values.to_numpy()
        classes, matrix = exchange(counts.astype(np.float64))
        yield pa.RecordBatch.from_arrays([pa.array([classes.tolist()], pa.list_(pa.int32())), pa.array([matrix.ravel()], pa.list_(pa.float64()))], names=["classes", "matrix"])

    got = pairs.coalesce(1).mapInArrow(run, "classes array<int>, matrix array<double>").collect()
    if not got:
        return np.append(np.arange(units) % CLASSES, END_CLASS), np.zeros((SIDE, SIDE))
    return np.array(got[0]["classes"]), np.array(got[0]["matrix"]).reshape(SIDE, SIDE)


def choose(word: np.ndarray, k: np.ndarray, n: np.ndarray, words: int, matrix: np.ndarray, now: np.ndarray, types: np.ndarray) -> np.ndarray:
    """The best class of each of `words` words. word, k, n: the words' class counts, k below SIDE to the left and above
    to the right. now: the class in which the matrix holds a word, -1 for none. types: the number of words of each class."""
    gain = np.tile(np.log(types + 1), (words, 1))
    out, into = matrix.sum(axis=1)[:CLASSES], matrix.sum(axis=0)[:CLASSES]
    for right in (False, True):
        mine = (k >= SIDE) == right
        w, c, x = word[mine], k[mine] % SIDE, n[mine].astype(np.float64)
        if not len(w):
            continue
        # a row per count: what the class bigrams hold, with each class in the word's place
        m = (matrix[:CLASSES, c] if right else matrix[c, :CLASSES].T).T.copy()
        held = np.flatnonzero(now[w] >= 0)
        m[held, now[w][held]] = np.maximum(m[held, now[w][held]] - x[held], 0)
        order = np.argsort(w, kind="stable")
        starts = np.flatnonzero(np.append(True, np.diff(w[order]) > 0))
        gain[w[order][starts]] += np.add.reduceat((_xlogx(m + x[:, None]) - _xlogx(m))[order], starts, axis=0)
        total = np.bincount(w, x, words)
        all_of = np.broadcast_to(out if right else into, (words, CLASSES)).copy()
        had = np.flatnonzero(now >= 0)
        all_of[had, now[had]] = np.maximum(all_of[had, now[had]] - total[had], 0)
        gain -= _xlogx(all_of + total[:, None]) - _xlogx(all_of)
    return gain.argmax(axis=1)


def _added(word: np.ndarray, k: np.ndarray, n: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The class bigrams that the counts give once the words have classes."""
    c, other, right = classes[word], k % SIDE, k >= SIDE
    return np.bincount(np.where(right, c * SIDE + other, other * SIDE + c), n, SIDE * SIDE).reshape(SIDE, SIDE)


#: Words whose gains are computed at once.
CHUNK = 2_000


def place_sent(train: DataFrame, own: int, classes: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all sent words, those from own on placed anew, and the class bigrams in which those take part, by the
    classes that were known. classes: of the sent words, -1 if not known."""
    spark = train.sparkSession
    sent = spark.sparkContext.broadcast(np.append(classes, [END_CLASS, -1]))  # at most SENT_WORDS
    end, types = len(classes), np.bincount(classes[classes >= 0], minlength=CLASSES)

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for at, _ in _runs(batches, end):
            path, mid = known[at], np.flatnonzero((at >= own) & (at < end))
            cells = []
            for step, first in ((-1, 0), (1, SIDE)):
                there = path[mid + step]
                cells.append((at[mid] * (2 * SIDE) + first + there)[there >= 0])
            cell, n = np.unique(np.concatenate(cells), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(n, pa.int32())], names=["cell", "n"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        held: dict[int, int] = {}  # word -> row of counts; a task's share of SENT_WORDS
        counts = np.zeros((1024, 2 * SIDE), np.int64)
        for batch in batches:
            cell, n = batch.column("cell").to_numpy(), batch.column("n").to_numpy()
            distinct, code = np.unique(cell // (2 * SIDE), return_inverse=True)
            rows = np.array([held.setdefault(w, len(held)) for w in distinct.tolist()], np.int64)
            while len(held) > len(counts):
                counts = np.concatenate([counts, np.zeros_like(counts)])
            np.add.at(counts, (rows[code], cell % (2 * SIDE)), n)
        ids, found, total = np.array(list(held), np.int64), np.zeros(len(held), np.int64), np.zeros((SIDE, SIDE))
        for start in range(0, len(ids), CHUNK):
            w, k = np.nonzero(counts[start : min(start + CHUNK, len(ids))])
            n = counts[start + w, k]
            mine = choose(w, k, n, min(CHUNK, len(ids) - start), matrix, known[ids[start : start + CHUNK]], types)
            found[start : start + CHUNK] = mine
            total += _added(w, k, n, mine)
        yield pa.RecordBatch.from_arrays([pa.array([ids]), pa.array([found]), pa.array([total.ravel()])], names=["word", "class", "matrix"])

    cells = train.mapInArrow(around, "cell long, n int")
    dealt = cells.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.floor(F.col("cell") / (2 * SIDE)))
    classes, total = classes.copy(), np.zeros((SIDE, SIDE))
    for r in dealt.mapInArrow(place, "word array<long>, class array<long>, matrix array<double>").toArrow().to_batches():
        for word, to, added in zip(r.column("word"), r.column("class"), r.column("matrix"), strict=True):
            if len(word.values):
                classes[word.values.to_numpy()] = to.values.to_numpy()
            total += added.values.to_numpy().reshape(SIDE, SIDE)
    # words that were never beside a word of a known class
    lost = np.flatnonzero(classes < 0)
    classes[lost] = lost % CLASSES
    return classes, total


def place_rest(train: DataFrame, classes: np.ndarray, matrix: np.ndarray) -> DataFrame:
    """The table of all other words, staged: word, c, class; and rows without a word whose matrices are, in sum, the class
    bigrams of all neighbours but two words of this table. matrix: the class bigrams as far as known, for the choice."""
    spark = train.sparkSession
    sent, end = spark.sparkContext.broadcast(np.append(classes, [END_CLASS, -1])), len(classes)
    both, types = SIDE + 1, np.bincount(classes, minlength=CLASSES)  # the last class: not known

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for at, words in _runs(batches, end):
            path, cold = known[at], np.flatnonzero(at < 0)
            pair = (path[cold - 1] % both) * both + path[cold + 1] % both
            found = Counter(zip(words, pair.tolist(), strict=True))
            # neighbours that are both sent words come without a word
            sides = path[:-1] * SIDE + path[1:]
            known_pairs, times = np.unique(sides[(path[:-1] >= 0) & (path[1:] >= 0)], return_counts=True)
            word = pa.concat_arrays([pa.array([w for w, _ in found], pa.binary()), pa.nulls(len(times), pa.binary())])
            yield pa.RecordBatch.from_arrays([word, pa.array([*(p for _, p in found), *known_pairs.tolist()], pa.int32()), pa.array([*found.values(), *times.tolist()], pa.int32())], names=["word", "pair", "n"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rest = np.zeros((SIDE, SIDE)), None

        def chosen(rows: pa.Table) -> pa.RecordBatch:
            nonlocal total
            words = rows.column("word").combine_chunks().dictionary_encode()
            code, pair, n = words.indices.to_numpy().astype(np.int64), rows.column("pair").to_numpy(), rows.column("n").to_numpy()
            left, right = pair // both, pair % both
            w = np.concatenate([code[left < SIDE], code[right < SIDE]])
            k = np.concatenate([left[left < SIDE], right[right < SIDE] + SIDE])
            x = np.concatenate([n[left < SIDE], n[right < SIDE]])
            cell, code_of = np.unique(w * (2 * SIDE) + k, return_inverse=True)  # each class once per word, in order
            w, k, x = cell // (2 * SIDE), cell % (2 * SIDE), np.bincount(code_of, x, len(cell))
            size = len(words.dictionary)
            to = choose(w, k, x, size, matrix, np.full(size, -1), types)
            total += _added(w, k, x, to)
            c = np.bincount(code, n, size).astype(np.int64)
            return pa.RecordBatch.from_arrays([words.dictionary, pa.array(c), pa.array(to, pa.int32()), pa.nulls(size, pa.list_(pa.float64()))], names=["word", "c", "class", "matrix"])

        # rows come sorted by word, those without one first: the last word of a part waits for the next
        for batch in batches:
            wordless = batch.column("word").null_count
            total += np.bincount(batch.column("pair").to_numpy()[:wordless], batch.column("n").to_numpy()[:wordless], SIDE * SIDE).reshape(SIDE, SIDE)
            for start in range(wordless, batch.num_rows, 4 * CHUNK):
                part = pa.Table.from_batches([batch.slice(start, 4 * CHUNK)])
                part = part if rest is None else pa.concat_tables([rest, part])
                words = part.column("word")
                codes = words.combine_chunks().dictionary_encode().indices.to_numpy()
                cut = int(np.searchsorted(codes, codes[-1]))
                rest = part.slice(cut)
                if cut:
                    yield chosen(part.slice(0, cut))
        if rest is not None:
            yield chosen(rest)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.array([total.ravel()], pa.list_(pa.float64()))], names=["word", "c", "class", "matrix"])

    rows = train.mapInArrow(around, "word binary, pair int, n int")
    # those without a word are a few thousand of each task, dealt by their pair
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.coalesce("word", F.col("pair").cast("string").cast("binary"))).sortWithinPartitions(F.asc_nulls_first("word"))
    return common.stage(dealt.mapInArrow(place, "word binary, c long, class int, matrix array<double>"), "rest")


def between_rest(train: DataFrame, rest: DataFrame, end: int) -> np.ndarray:
    """The class bigrams of neighbours that are both words of rest. train: numbered(); rest: word, class."""

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, words in _runs(batches, end):
            met = np.flatnonzero(np.diff(np.flatnonzero(at < 0)) == 1).tolist()
            found = Counter((words[k], words[k + 1]) for k in met)
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.binary()), pa.array([b for _, b in found], pa.binary()), pa.array(found.values(), pa.int64())], names=["first", "second", "n"])

    class_of = lambda word: rest.select(F.col("word").alias(word), F.col("class").alias(f"class_{word}")).hint("merge")
    left = train.mapInArrow(beside, "first binary, second binary, n long").join(class_of("first"), "first")
    both = left.groupBy("second", "class_first").agg(F.sum("n").alias("n")).join(class_of("second"), "second")
    total = np.zeros((SIDE, SIDE))
    for r in both.groupBy("class_first", "class_second").agg(F.sum("n").alias("n")).collect():  # at most CLASSES squared
        total[r["class_first"], r["class_second"]] = r["n"]
    return total


@dataclass(frozen=True)
class Model:
    """Of a fixed size but for words, counts and classes, which hold at most SENT_WORDS."""

    words: dict[bytes, int]
    counts: np.ndarray
    classes: np.ndarray
    transitions: np.ndarray
    emission_below: np.ndarray
    base_below: float
    end_count: int
    train_tokens: int


def smoothed(matrix: np.ndarray, below: np.ndarray) -> np.ndarray:
    """log10 of the class transitions, and a last row and column for unseen words: to them with their emission, and from them."""
    chance = (matrix + TRANSITION_SMOOTHING) / (matrix.sum(axis=1, keepdims=True) + TRANSITION_SMOOTHING * SIDE)
    into = matrix.sum(axis=0) + TRANSITION_SMOOTHING
    chance = np.concatenate([chance, into[None] / into.sum()])
    return np.log10(np.concatenate([chance, chance[:, :CLASSES] @ (SMOOTHING / 10 ** below[:CLASSES])[:, None]], axis=1))


def least_sent(counts: DataFrame) -> int:
    """The least count at which the words with it or more are at most SENT_WORDS. It comes from how many words have each
    count, a table that partial aggregates keep small; no task gathers the words themselves."""
    many = counts.groupBy("c").agg(F.count("*").alias("n")).toArrow().sort_by([("c", "descending")])
    c, words = many.column("c").to_numpy(), np.cumsum(many.column("n").to_numpy())
    fits = int(np.searchsorted(words, SENT_WORDS, side="right"))
    return int(c[fits - 1]) if fits else 2**62


def sent_words(counts: DataFrame) -> tuple[_Index, np.ndarray]:
    """The numbers of the sent words, most frequent first, and their counts. counts: (word, c), staged."""
    top = counts.filter(F.col("c") >= least_sent(counts)).toArrow().sort_by([("c", "descending"), ("word", "ascending")])
    return _Index((w, i) for i, w in enumerate(top.column("word").to_pylist())), top.column("c").to_numpy().astype(np.float64)


def train_model(train: DataFrame, counts: DataFrame, all_pairs: bool = False) -> tuple[Model, DataFrame]:
    """train: text; counts: (word, c), staged. The model, and the table of the words that are not sent: word, c, class.
    The transitions count all neighbours with all_pairs, and otherwise all but two words of that table."""
    index, c = sent_words(counts)
    return fitted(numbered(train.select("text"), index), index, c, all_pairs)


def fitted(train: DataFrame, index: _Index, c: np.ndarray, all_pairs: bool = False) -> tuple[Model, DataFrame]:
    """train_model() of numbered() texts."""
    own = min(OWN_WORDS, len(index))
    own_classes, matrix = cluster(common.stage(count_pairs(train, own, len(index)), "pairs"), own)
    classes = np.append(own_classes[:own], np.full(len(index) - own, -1)).astype(np.int64)
    if len(index) > own:
        own_matrix = matrix
        for _ in range(2):
            classes, added = place_sent(train, own, classes, matrix)
            matrix = own_matrix + added
    rest = place_rest(train, classes, matrix)
    matrix = np.zeros((SIDE, SIDE))
    for r in rest.filter("word is null").select("matrix").toLocalIterator():  # one per task
        matrix = matrix + np.array(r["matrix"]).reshape(SIDE, SIDE)
    rest = rest.filter("word is not null").select("word", "c", "class")
    sums = rest.groupBy("class").agg(F.count("*").alias("types"), F.sum("c").alias("c")).collect()
    if all_pairs and sums:
        matrix = matrix + between_rest(train, rest, len(index))
    of_class = lambda x: np.bincount(classes, x, CLASSES)[:CLASSES]
    types, total = of_class(np.ones(len(index))), of_class(c)
    for r in sums:
        types[r["class"]] += r["types"]
        total[r["class"]] += r["c"]
    ends = int(matrix[END_CLASS].sum())
    n, v = int(total.sum()) + ends, int(types.sum()) + (ends > 0)
    below = np.append(np.log10(total + SMOOTHING * (types + 1)), 0.0)
    transitions = smoothed(matrix, below)
    return Model(index, c, classes, transitions, below, float(np.log10(n + SMOOTHING * (v + 1))), ends, n), rest


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", all_pairs: bool = False) -> DataFrame:
    """One row per row of docs: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score. all_pairs: as in train_model().

    Learns from the rows that are not held out. score is the log10 probability of the text with its end token; the
    perplexity is 10 ** (-score / n_tokens). Null texts count as empty (the end token alone), a null id as the id ''.
    With no training rows every word has count 0. An empty table gives no rows; other columns are not read.
    """
    slim = docs.select(F.col(id_col).alias("doc"), held_out(id_col).alias("held_out"), F.monotonically_increasing_id().alias("row_no"), F.col(text_col).alias("text"))
    index, c = sent_words(common.stage(count_words(slim.filter(~F.col("held_out")).select("text")), "words"))
    numbers = numbered(slim, index)
    model, rest = fitted(numbers.filter(~F.col("held_out")).select("ids", "cold"), index, c, all_pairs)
    sent = docs.sparkSession.sparkContext.broadcast(replace(model, words={}))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = sent.value
        log_counts, end = np.append(np.log10(m.counts + SMOOTHING), 0.0), np.log10(m.end_count + SMOOTHING)
        ids, lens = _flat(batch)
        # each text with an end before and after it, one after the other
        size = lens + 2
        starts = np.append(0, np.cumsum(size)[:-1])
        place = np.arange(len(ids)) + 1 + 2 * np.repeat(np.arange(len(lens)), lens)
        path, known, seen = np.full(size.sum(), END_CLASS), np.zeros(size.sum()), np.zeros(size.sum(), np.int64)
        path[place], known[place], seen[place] = np.append(m.classes, -1)[ids], log_counts[ids], ids >= 0
        step = np.append(np.where((path[:-1] >= 0) & (path[1:] >= 0), m.transitions[path[:-1], path[1:]], 0.0), 0.0)
        step[starts + size - 1] = 0.0
        below = np.where(path >= 0, m.emission_below[path], 0.0)
        sums = [np.add.reduceat(x, starts) for x in (known, step - below, seen)]
        cold = place[ids < 0]
        words = batch.column("cold")
        offsets = np.append(0, np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False)))
        rare = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pc.list_flatten(words), *(pa.array(path[cold + k].astype(np.int32)) for k in (-1, 1))], names=["word", "left", "right"]))
        columns = [pa.array(lens + 1, pa.int64()), pa.array(sums[2] + (m.end_count > 0)), pa.array(sums[0] + end - m.base_below * (lens + 1)), pa.array(sums[0] + sums[1])]
        return pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("held_out"), batch.column("row_no"), *columns, rare], names=["doc", "held_out", "row_no", "n_tokens", "known", "base", "score", "rare"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc {kind}, held_out boolean, row_no long, n_tokens long, known long, base double, score double, rare array<struct<word:binary,left:int,right:int>>"
    rows = common.stage(common.map_batches(numbers, one, schema), "scored")
    more = _of_rare(rows.select("row_no", F.posexplode("rare").alias("place", "x")).select("row_no", "place", "x.*"), rest, model)
    out = rows.drop("rare").join(more, F.col("row_no") == F.col("of"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        F.col("doc").alias(id_col), "held_out", "n_tokens", (F.col("known") + zero("more_known")).cast("long").alias("n_known"), F.lit(model.train_tokens).cast("long").alias("train_tokens"), (F.col("base") + zero("more_base")).alias("base_score"), (F.col("score") + zero("more_score")).alias("score")
    )


def _of_rare(rare: DataFrame, rest: DataFrame, model: Model) -> DataFrame:
    """(of, more_known, more_base, more_score) per row_no: what the words that are not sent add to a document. left and
    right: the classes beside a word, -1 beside another such word, which then is the one before or after it in place."""
    joined = rare.join(rest, "word", "left").select("row_no", "place", "left", "right", F.coalesce("class", F.lit(UNSEEN)).alias("class"), F.coalesce("c", F.lit(0)).alias("c"))
    table = lambda values: F.from_json(F.lit(str(values)), "array<double>")
    transitions = table(model.transitions.ravel().tolist())
    step = lambda a, b: F.get(transitions, a * (SIDE + 1) + b)
    before = F.lag("class").over(Window.partitionBy("row_no").orderBy("place"))
    joined = joined.withColumn("left", F.when(F.col("left") >= 0, F.col("left")).otherwise(before))
    log_count = F.log10(F.col("c") + F.lit(SMOOTHING))
    score = step(F.col("left"), F.col("class")) + F.when(F.col("right") >= 0, step(F.col("class"), F.col("right"))).otherwise(0.0)
    score += F.when(F.col("class") == UNSEEN, 0.0).otherwise(log_count - F.get(table(model.emission_below.tolist()), F.col("class")))
    return joined.withColumn("score", score).groupBy(F.col("row_no").alias("of")).agg(F.count_if(F.col("c") > 0).alias("more_known"), F.sum(log_count).alias("more_base"), F.sum("score").alias("more_score"))
