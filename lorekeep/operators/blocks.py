"""A block-max index: postings of a few notes per row, with what bounds a term's gain in them.

A block holds up to ``size`` notes and, per search field, its own dictionary with the postings of each term,
the term's largest frequency and the length of the shortest note that has it. From these follows the largest
gain a term can have in the block under any corpus statistics, so blocks never change when notes are added
elsewhere. Blocks are made where the notes lie, without a shuffle.

A search takes queries in blocks of bounded size, which every task holds. It first cuts the index to the terms asked
for (one pass, written), then reads that cut twice: for the candidates and channel maxima of each query, and for
the ranking. Blocks come by falling bound, and a query skips a block whose bound is below what it has already.
Nothing is shuffled but one row per query and task, and at most k results per query and task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lorekeep.functions import text as T
from lorekeep.operators import index as I
from lorekeep.session import written

K1, B = 1.5, 0.75
_POSTINGS = "struct<term:array<{0}>,most_tf:array<int>,least_dl:array<int>,df:array<int>,place:array<int>,tf:array<int>>"
_INTS = ("most_tf", "least_dl", "df", "place", "tf")


def _schema(kind: str, term: str) -> str:
    fields = [f"{f} {_POSTINGS.format(term)}, {f}_dl array<int>" for f in I.FIELDS]
    return f"notes array<{kind}>, hay_len array<int>, " + ", ".join(fields)


def _one(values, kind: pa.DataType) -> pa.Array:
    """A list column with one row."""
    values = values if isinstance(values, pa.Array) else pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _struct(term, numbers: dict[str, np.ndarray], kind: pa.DataType) -> pa.StructArray:
    return pa.StructArray.from_arrays([_one(term, kind), *[_one(numbers[c], pa.int32()) for c in _INTS]], ["term", *_INTS])


_NAMES = ["notes", "hay_len", *[x for f in I.FIELDS for x in (f, f"{f}_dl")]]


def _packed(notes: pa.Array, hay_len: np.ndarray, fields: dict) -> pa.RecordBatch:
    """One block of ``notes``. A field has its dictionary, per posting the code of the term, place and frequency, and the
    length of every note."""
    columns = [_one(notes, None), _one(hay_len, pa.int32())]
    for f in I.FIELDS:
        words, code, place, tf, dl = fields[f]
        order = np.lexsort((place, code))
        code, place, tf = code[order], place[order], tf[order]
        df = np.bincount(code, minlength=len(words))
        first = np.cumsum(df) - df
        bound = {"most_tf": np.maximum.reduceat(tf, first), "least_dl": np.minimum.reduceat(dl[place], first)} if len(tf) else {"most_tf": tf, "least_dl": tf}
        columns += [_struct(words, {**bound, "df": df, "place": place, "tf": tf}, words.type), _one(dl, pa.int32())]
    return pa.RecordBatch.from_arrays(columns, _NAMES)


def build_blocks(notes: DataFrame, size: int = 512) -> DataFrame:
    """The index of ``notes``: one row per block of up to ``size`` of them."""
    terms = I.note_terms(notes)
    kind = dict(terms.dtypes)["note_id"]

    def pack(batches):
        for whole in batches:
            for at in range(0, len(whole), size):
                batch = whole.slice(at, size)
                n, fields = len(batch), {}
                for f in I.FIELDS:
                    lists = batch.column(batch.schema.get_field_index(f))
                    dl = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
                    coded = pc.dictionary_encode(lists.flatten())
                    met, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(n), dl), return_counts=True)
                    fields[f] = coded.dictionary, met // n, met % n, tf, dl
                yield _packed(batch.column(0), fields["haystack"][4], fields)

    return terms.mapInArrow(pack, _schema(kind, "string"))


def merge_blocks(blocks: DataFrame, size: int = 512) -> DataFrame:
    """The same index in blocks of up to ``size`` notes, without the notes at the places ``gone`` of each block."""
    kind = dict(blocks.dtypes)["notes"][6:-1]

    def merged(held):
        kept = [np.setdiff1d(np.arange(len(b["notes"])), b["gone"].to_numpy()) for b in held]
        notes = pa.concat_arrays([b["notes"].take(pa.array(k)) for b, k in zip(held, kept, strict=True)])
        fields = {}
        for f in I.FIELDS:
            words, codes, places, tfs, lengths, at, known = [], [], [], [], [], 0, 0
            for b, k in zip(held, kept, strict=True):
                part = b[f]
                to = np.full(len(b["notes"]), -1, np.int64)
                to[k] = np.arange(len(k)) + at
                code = np.repeat(np.arange(len(part["term"])), part["df"].to_numpy())
                place = to[part["place"].to_numpy()]
                good = place >= 0
                words.append(part["term"])
                codes.append(code[good] + known)
                places.append(place[good])
                tfs.append(part["tf"].to_numpy()[good])
                lengths.append(b[f"{f}_dl"].to_numpy()[k])
                at, known = at + len(k), known + len(part["term"])
            # one dictionary of the terms that are left
            coded = pc.dictionary_encode(pa.concat_arrays(words))
            code = coded.indices.to_numpy().astype(np.int64)[np.concatenate(codes)] if known else np.zeros(0, np.int64)
            left, code = np.unique(code, return_inverse=True)
            fields[f] = coded.dictionary.take(pa.array(left)), code, np.concatenate(places), np.concatenate(tfs).astype(np.int64), np.concatenate(lengths).astype(np.int64)
        return _packed(notes, fields["haystack"][4], fields)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for block in _rows(batch):
                live = len(block["notes"]) - len(block["gone"])
                if held and n + live > size:
                    yield merged(held)
                    held, n = [], 0
                if live:
                    if 2 * live < len(block["notes"]):  # a copy of what lives, else the dead rest of its batch is held too
                        block = {**next(_rows(merged([block]))), "gone": pa.array([], pa.int32())}
                    held.append(block)
                    n += live
        if held:
            yield merged(held)

    return blocks.mapInArrow(run, _schema(kind, "string"))


def postings_of(blocks: DataFrame, rows: int = 1 << 16) -> DataFrame:
    """field, term, note_id, tf, dl, hay_len: the postings of the blocks one by one, ``rows`` of them at a time."""
    made = StructType.fromDDL(f"field string, term string, note_id {dict(blocks.dtypes)['notes'][6:-1]}, tf bigint, dl int, hay_len int")
    kinds = [f.type for f in to_arrow_schema(made)]

    def run(batches):
        for batch in batches:
            for block in _rows(batch):
                for f in I.FIELDS:
                    part = block[f]
                    code = np.repeat(np.arange(len(part["term"])), part["df"].to_numpy())
                    for at in range(0, len(code), rows):
                        place = part["place"].slice(at, rows)
                        columns = [
                            pa.repeat(f, len(place)), part["term"].take(pa.array(code[at : at + rows])), block["notes"].take(place),
                            part["tf"].slice(at, rows), block[f"{f}_dl"].take(place), block["hay_len"].take(place),
                        ]
                        yield pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(columns, kinds, strict=True)], made.names)

    return blocks.select("notes", "hay_len", *[c for f in I.FIELDS for c in (f, f"{f}_dl")]).mapInArrow(run, made)


def term_sums(blocks: DataFrame) -> DataFrame:
    """field, term, df, total_tf, total_dl over the notes that are not at the places ``gone`` of their block.

    A block adds up its own postings, so one row per term and block leaves it, not one per posting.
    """
    made = StructType.fromDDL("field string, term string, df bigint, total_tf bigint, total_dl bigint")

    def run(batches):
        for batch in batches:
            for block in _rows(batch):
                live = np.ones(len(block["notes"]), bool)
                live[block["gone"].to_numpy()] = False
                for f in I.FIELDS:
                    part = block[f]
                    if not len(part["term"]):
                        continue
                    df, place = part["df"].to_numpy().astype(np.int64), part["place"].to_numpy()
                    first, here = np.cumsum(df) - df, live[place]
                    dl = block[f"{f}_dl"].to_numpy().astype(np.int64)[place]
                    sums = [np.add.reduceat(x * here, first) for x in (np.ones(len(place), np.int64), part["tf"].to_numpy().astype(np.int64), dl)]
                    some = sums[0] > 0
                    columns = [pa.repeat(f, int(some.sum())), part["term"].filter(pa.array(some)), *[pa.array(x[some]) for x in sums]]
                    yield pa.RecordBatch.from_arrays(columns, made.names)

    columns = ["notes", "gone", *[c for f in I.FIELDS for c in (f, f"{f}_dl")]]
    each = blocks.select(*columns).mapInArrow(run, made)
    return each.groupBy("field", "term").agg(*[F.sum(c).alias(c) for c in ("df", "total_tf", "total_dl")])


def gain(tf: np.ndarray, dl: np.ndarray, mean: float) -> np.ndarray:
    """The BM25 part of a posting without its idf."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * np.maximum(dl, 1) / mean))


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """The blocks of a batch, lists as arrays."""
    for i in range(len(batch)):
        row = {}
        for name, column in zip(batch.schema.names, batch.columns, strict=True):
            if pa.types.is_struct(column.type):
                row[name] = {x.name: column.field(k)[i].values for k, x in enumerate(column.type)}
            else:
                row[name] = column[i].values
        yield row


class _Query:
    """The arrays of one block of queries: per field the terms of every query, and the weights."""

    def __init__(self, starts, terms, idf=None, means=None):
        self.starts, self.terms, self.idf, self.means = starts, terms, idf, means

    def of(self, f: str, q: int) -> np.ndarray:
        return self.terms[f][self.starts[f][q] : self.starts[f][q + 1]]

    def bounds(self, block: dict, f: str) -> np.ndarray:
        """Per query the largest score of the field in the block."""
        part, top = block[f], np.zeros(len(self.idf[f]) + 1)
        v = part["term"].to_numpy()
        top[v] = self.idf[f][v] * gain(part["most_tf"].to_numpy(), part["least_dl"].to_numpy(), self.means[f])
        starts = self.starts[f]
        # the last entry of top is 0: it closes the last query and stands for queries without a term
        sums = np.concatenate(([0.0], np.cumsum(top[self.terms[f]])))
        return sums[starts[1:]] - sums[starts[:-1]]

    def postings(self, block: dict, f: str):
        """A function from a query to its raw scores in the block, and one that marks its notes."""
        part = block[f]
        v, df, place = part["term"].to_numpy(), part["df"].to_numpy(), part["place"].to_numpy()
        ends = np.cumsum(df)
        slot = np.full(len(self.idf[f]), -1, np.int64)
        slot[v] = np.arange(len(v))
        gains = np.repeat(self.idf[f][v], df) * gain(part["tf"].to_numpy(), block[f"{f}_dl"].to_numpy()[place], self.means[f])

        def spans(q):
            s = slot[self.of(f, q)]
            return [(int(ends[x] - df[x]), int(ends[x])) for x in s[s >= 0].tolist()]

        def scores(q, out):
            for a, b in spans(q):
                out[place[a:b]] += gains[a:b]
            return out

        def mark(q, out):
            for a, b in spans(q):
                out[place[a:b]] = True

        return scores, mark


def search_blocks(
    queries: DataFrame, blocks: DataFrame, corpus: DataFrame, limit: int, *, scales: dict[str, float], damping: float, chars: int = 1_000_000
) -> DataFrame:
    """query_id, note_id, raw_score, rank: the three channels, each over its best, scaled, added and damped by length.

    ``chars`` bounds the text of the queries that tasks hold at once.
    """
    asked = queries.select("query_id", F.array_distinct(T.tokens("text")).alias("stems"), F.array_distinct(T.query_trigrams("text")).alias("grams"), "text")
    parts = max(1, -(-(asked.agg(F.sum(F.length("text"))).first()[0] or 0) // chars))
    found = None
    for number in range(parts):
        own = asked if parts == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == number)
        one = _search(own.drop("text"), blocks, corpus, limit, scales, damping)
        found = one if found is None else found.unionByName(one)
    return found


def _search(asked: DataFrame, blocks: DataFrame, corpus: DataFrame, limit: int, scales: dict, damping: float) -> DataFrame:
    spark = blocks.sparkSession
    rows, about = asked.collect(), corpus.first()
    kinds = {"query_id": dict(asked.dtypes)["query_id"], "note_id": dict(blocks.dtypes)["notes"][6:-1]}
    lists = {"haystack": [r.stems or [] for r in rows], "tri_title": [r.grams or [] for r in rows]}
    lists["tri_summary"] = lists["tri_title"]
    words, starts, terms = {}, {}, {}
    for f, own in lists.items():
        words[f] = sorted({t for x in own for t in x})
        number = {t: n for n, t in enumerate(words[f])}
        starts[f] = np.cumsum([0, *map(len, own)])
        terms[f] = np.array([number[t] for x in own for t in x], np.int64)
    vocabulary = spark.sparkContext.broadcast(words)

    def cut(batches):
        wanted = {f: pa.array(w, pa.string()) for f, w in vocabulary.value.items()}
        for batch in batches:
            for block in _rows(batch):
                columns = [_one(block["notes"], None), _one(block["hay_len"], None)]
                for f in I.FIELDS:
                    part = block[f]
                    at = pc.index_in(part["term"], value_set=wanted[f])
                    here = at.is_valid().to_numpy(zero_copy_only=False)
                    df = part["df"].to_numpy()
                    keep = np.repeat(here, df)
                    numbers = {c: part[c].to_numpy()[keep if c in ("place", "tf") else here] for c in _INTS}
                    columns += [_struct(pc.drop_null(at), numbers, pa.int32()), _one(block[f"{f}_dl"], None)]
                yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    small = written(blocks.mapInArrow(cut, _schema(kinds["note_id"], "int")))
    counted = None
    for k, f in enumerate(I.FIELDS):
        zipped = F.arrays_zip(F.col(f)["term"].alias("v"), F.col(f)["df"].alias("df"))
        part = small.select(F.lit(k).alias("f"), F.explode(zipped).alias("x")).select("f", "x.v", "x.df")
        counted = part if counted is None else counted.unionByName(part)
    idf = {f: np.zeros(len(words[f])) for f in I.FIELDS}
    for r in counted.groupBy("f", "v").agg(F.sum("df").alias("df")).collect():
        idf[I.FIELDS[r.f]][r.v] = np.log(1 + (about["n"] - r.df + 0.5) / (r.df + 0.5))
    means = {f: float(about[f]) if about[f] else 1.0 for f in I.FIELDS}
    shared = spark.sparkContext.broadcast((starts, terms, idf, means))
    size = len(rows)

    def survey(batches):
        asked = _Query(*shared.value)
        n, length = np.zeros(size, np.int64), np.zeros(size, np.int64)
        top = {f: np.zeros(size) for f in I.FIELDS}
        for batch in batches:
            held = [(b, {f: asked.bounds(b, f) for f in I.FIELDS}) for b in _rows(batch)]
            held.sort(key=lambda x: -float(x[1]["haystack"].max(initial=0)))
            for block, bounds in held:
                hay = block["hay_len"].to_numpy()
                opened = {f: asked.postings(block, f) for f in I.FIELDS}
                for q in np.flatnonzero(sum(bounds.values()) > 0).tolist():
                    seen = np.zeros(len(hay), bool)
                    for f, (scores, mark) in opened.items():
                        mark(q, seen)
                        if bounds[f][q] > top[f][q]:
                            top[f][q] = max(top[f][q], scores(q, np.zeros(len(hay))).max(initial=0))
                    n[q] += seen.sum()
                    length[q] += hay[seen].sum()
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x[some]) for x in (np.arange(size), n, length, *top.values())], ["q", "n", "length", *I.FIELDS]
        )

    told = small.mapInArrow(survey, "q long, n long, length long, " + ", ".join(f"{f} double" for f in I.FIELDS))
    told = told.groupBy("q").agg(F.sum("n").alias("n"), F.sum("length").alias("length"), *[F.max(f).alias(f) for f in I.FIELDS])
    top, mean = {f: np.zeros(size) for f in I.FIELDS}, np.full(size, -1.0)
    for r in told.collect():
        mean[r.q] = r.length / r.n
        for f in I.FIELDS:
            top[f][r.q] = r[f]
    ids = [r.query_id for r in rows]
    plan = spark.sparkContext.broadcast((ids, top, mean))

    def visit(batches):
        asked, (ids, top, mean) = _Query(*shared.value), plan.value
        share = {f: np.where(top[f] > 0, scales[f] / np.where(top[f] > 0, top[f], 1), 0) for f in I.FIELDS}
        best: dict[int, list[tuple[float, object]]] = {}
        least = np.full(size, -np.inf)

        def damp(blend, q, length):
            return blend * mean[q] / (mean[q] + damping * length) if mean[q] > 0 else blend

        for batch in batches:
            held = []
            for block in _rows(batch):
                limits = sum(np.minimum(asked.bounds(block, f) * share[f], scales[f]) for f in I.FIELDS)
                factor = np.where(mean > 0, mean / (mean + damping * block["hay_len"].to_numpy().min(initial=1 << 30)), 1)
                held.append((block, np.where(limits > 0, limits * factor, -np.inf)))
            held.sort(key=lambda x: -float(x[1].max(initial=-np.inf)))
            for block, limits in held:
                open_ = np.flatnonzero((limits > -np.inf) & (np.rint(limits * 1e9) + 1 >= least) & (mean >= 0))
                if not len(open_):
                    continue
                hay = block["hay_len"].to_numpy()
                names = None
                opened = {f: asked.postings(block, f) for f in I.FIELDS}
                for q in open_.tolist():
                    blend, seen = np.zeros(len(hay)), np.zeros(len(hay), bool)
                    for f, (scores, mark) in opened.items():
                        mark(q, seen)
                        if share[f][q]:
                            blend += scores(q, np.zeros(len(hay))) * share[f][q]
                    at = np.flatnonzero(seen)
                    value = damp(blend[at], q, hay[at])
                    key = np.rint(value * 1e9)
                    if len(at) > limit:
                        some = key >= np.partition(key, len(key) - limit)[len(key) - limit]
                        at, value, key = at[some], value[some], key[some]
                    some = key >= least[q]
                    names = names if names is not None else block["notes"].to_pylist()
                    ours = best.get(q, []) + [(-k, names[i], v) for k, i, v in zip(key[some].tolist(), at[some].tolist(), value[some].tolist(), strict=True)]
                    best[q] = sorted(ours, key=lambda x: x[:2])[:limit]
                    if len(best[q]) == limit:
                        least[q] = -best[q][-1][0]
        flat = [(ids[q], name, value) for q, own in best.items() for _, name, value in own]
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*flat, strict=True) if flat else [(), (), ()], types, strict=True)], ["query_id", "note_id", "raw_score"])

    made = StructType.fromDDL(f"query_id {kinds['query_id']}, note_id {kinds['note_id']}, raw_score double")
    types = [f.type for f in to_arrow_schema(made)]
    order = Window.partitionBy("query_id").orderBy(F.desc(F.rint(F.col("raw_score") * 1e9)), F.asc("note_id"))
    return small.mapInArrow(visit, made).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
