"""Template match: the templates whose intents fit a request best, with a score, the first three, and what to do with them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window as W

from ..sources.sinks import kept
from .similarity import template_band

UNIT = 1_000_000
#: Different sets of a block of requests and of templates, and codes of a block of templates.
REQUESTS, TEMPLATES, CODES = 2048, 262_144, 4_000_000
#: Requests of a block that go down a tree at once, cells of their matrix with the intents, nodes that are looked at in one step, found pairs that wait for their order.
SLICE, CELLS, NODES, FOUND = 2048, 2_000_000, 131_072, 1_000_000
#: Scores that are searched down to, one after the other, until k templates are found.
LEVELS = (UNIT, 840_000, 740_000, 650_000, 550_000, 400_000, 200_000, 0)
#: Places for each core that requests are dealt to.
PLACES = 4


def intent_weights(templates: DataFrame) -> DataFrame:
    """intent, w: the rarer an intent among the templates, the heavier, in whole millionths: 1 + log(templates / with it)."""
    n = templates.select("template_id").distinct().agg(F.count("*").alias("n"))  # one row
    rarity = templates.groupBy("intent").agg(F.count_distinct("template_id").alias("df")).join(F.broadcast(n), F.lit(True))
    return rarity.select("intent", F.floor(UNIT * (1 + F.log(F.col("n") / F.col("df")))).cast("bigint").alias("w"))


def _coded(pairs: DataFrame, key: str, codes: DataFrame, alone: DataFrame) -> DataFrame:
    """key, codes, ws, total of every key: the sorted codes of its different intents and their weights, as bytes (big-endian, 4 and 8
    each), and the sum of weights; intents without a code count in the sum only. A null key has no intents."""
    x = pairs.select(key, F.when(F.col(key).isNotNull(), F.col("intent")).alias("intent")).join(codes, "intent", "left").join(F.broadcast(alone), F.lit(True))
    x = x.select(key, "code", F.when(F.col("code").isNull(), F.col("intent")).alias("other"), F.when(F.col("intent").isNotNull(), F.coalesce("w", "alone")).alias("w"))
    out = T.StructType([x.schema[key], T.StructField("codes", T.BinaryType()), T.StructField("ws", T.BinaryType()), T.StructField("total", T.LongType())])
    arrow = to_arrow_schema(out)

    def same(column: pa.Array) -> np.ndarray:
        """Of each row but the first whether it has what the row before has."""
        a, b = column[1:], column[:-1]
        both = pc.and_(a.is_null(), b.is_null())
        return pc.or_(pc.fill_null(pc.equal(a, b), False), both).to_numpy(zero_copy_only=False)

    def of(rows: pa.RecordBatch, old: np.ndarray) -> pa.RecordBatch:
        run = np.concatenate([[0], (~old).cumsum()])
        first = np.flatnonzero(np.concatenate([[True], ~old]))
        known = rows.column(1).is_valid().to_numpy(zero_copy_only=False)
        w = pc.fill_null(rows.column(3), 0).to_numpy()
        cells, at = np.unique(run[known] << 32 | pc.fill_null(rows.column(1), 0).to_numpy()[known], return_index=True)
        ws = w[known][at]
        ends = np.concatenate([[0], np.bincount(cells >> 32, minlength=len(first)).cumsum()])
        sums = np.concatenate([[0], ws.cumsum()])
        total = sums[ends[1:]] - sums[ends[:-1]]
        strange = rows.column(2).is_valid().to_numpy(zero_copy_only=False)
        if strange.any():
            names = rows.column(2).filter(pa.array(strange)).dictionary_encode().indices.to_numpy()
            pairs = np.unique(run[strange] << 32 | names)
            total = total + np.bincount(pairs >> 32, minlength=len(first)) * w[strange][0]
        cut = lambda values, size: pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((size * ends).astype(np.int32)), pa.py_buffer(values.tobytes())])
        return pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(first)), cut((cells & 0xFFFFFFFF).astype(">u4"), 4), cut(ws.astype(">i8"), 8), pa.array(total)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = []  # rows of the last key, which may go on
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if rest and not same(pa.concat_arrays([rest[-1].column(0)[-1:], batch.column(0)[:1]]))[0]:
                rows = pa.Table.from_batches(rest).combine_chunks().to_batches()[0]
                yield of(rows, same(rows.column(0)))
                rest = []
            old = same(batch.column(0))
            last = len(old) - np.argmin(old[::-1]) if not old.all() else 0  # first row of the last key
            if last == 0:
                rest.append(batch)
                continue
            rows = pa.Table.from_batches([*rest, batch[:last]]).combine_chunks().to_batches()[0]
            yield of(rows, same(rows.column(0)))
            rest = [batch[last:]]
        if rest:
            rows = pa.Table.from_batches(rest).combine_chunks().to_batches()[0]
            yield of(rows, same(rows.column(0)))

    return x.repartition(key).sortWithinPartitions(key).mapInArrow(run, out)


def _packed(df: DataFrame, columns: list[str], size: int, codes: int) -> DataFrame:
    """Rows of `block`, an array of at most `size` structs of the columns, with at most `codes` codes if there are several."""
    schema = T.StructType([T.StructField("block", T.ArrayType(df.select(F.struct(*columns).alias("x")).schema[0].dataType))])
    arrow = to_arrow_schema(schema)

    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        rows = pa.StructArray.from_arrays(rows.columns, fields=list(arrow.field(0).type.value_type))
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows).cast(arrow.field(0).type)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n, weight = [], 0, 0
        for batch in batches:
            long = pc.binary_length(batch.column(0)).to_numpy().astype(np.int64).cumsum() // 4
            lo = 0
            while lo < batch.num_rows:
                done = int(long[lo - 1]) if lo else 0
                take = min(batch.num_rows - lo, size - n, int(np.searchsorted(long, done + codes - weight, "right")) - lo)
                if take <= 0 and n == 0:
                    take = 1
                if take > 0:
                    parts.append(batch.slice(lo, take))
                    n, lo, weight = n + take, lo + take, weight + int(long[lo + take - 1]) - done
                if lo < batch.num_rows or n >= size:
                    yield block(parts)
                    parts, n, weight = [], 0, 0
        if parts:
            yield block(parts)

    return df.select(*columns).mapInArrow(run, schema)


def _numbers(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in all rows' bytes, one after the other, and of each row how many."""
    column = column.cast(pa.binary())
    many = pc.binary_length(column).to_numpy().astype(np.int64) // np.dtype(kind).itemsize
    size = np.dtype(kind).itemsize
    start = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)[0] if len(column) else 0
    return np.frombuffer(column.buffers()[2] or b"", kind, many.sum(), start).astype(np.int64) if many.sum() else np.zeros(0, np.int64), many


class _Tree:
    """The sets of a block of templates as a tree of their sorted codes. Of each depth's nodes: the intent, the weight of the
    way to it, the least sum of weights of the sets below and what the heaviest adds to the way, the set that ends here (or -1), the first child."""

    def __init__(self, block: pa.StructArray) -> None:
        block = block.take(pc.sort_indices(block.field("codes")))
        codes, many = _numbers(block.field("codes"), ">u4")
        ws, _ = _numbers(block.field("ws"), ">i8")
        self.codes, first, local = np.unique(codes, return_index=True, return_inverse=True)
        self.weights = ws[first].astype(np.float64)
        keys = block.field("keys")
        self.ids = keys.flatten()
        self.many = pc.list_value_length(keys).to_numpy().astype(np.int64)
        self.first = self.many.cumsum() - self.many
        self.place = np.empty(len(self.ids), np.int64)
        self.by_place = pc.sort_indices(self.ids).to_numpy()
        self.place[self.by_place] = np.arange(len(self.ids))
        start, size = many.cumsum() - many, pc.cast(block.field("total"), pa.float64()).to_numpy()
        self.levels, self.looked = [], 0  # nodes that were looked at
        on = np.flatnonzero(many > 0)
        parent, way = np.zeros(len(on), np.int64), np.zeros(len(on))
        depth = 0
        while len(on):
            code = local[start[on] + depth]
            new = np.concatenate([[True], (parent[1:] != parent[:-1]) | (code[1:] != code[:-1])])
            head = np.flatnonzero(new)
            way = way + self.weights[code]
            ends = many[on] == depth + 1
            set_ = np.full(len(head), -1)
            node = new.cumsum() - 1
            set_[node[ends]] = on[ends]
            if self.levels:
                self.levels[-1]["child"] = np.searchsorted(parent[head], np.arange(len(self.levels[-1]["code"]) + 1))
            self.levels.append({"code": code[head], "way": way[head], "least": np.minimum.reduceat(size[on], head), "adds": np.maximum.reduceat(size[on], head) - way[head], "set": set_, "child": np.zeros(len(head) + 1, np.int64)})
            on, parent, way = on[~ends], node[~ends], way[~ends]
            depth += 1

    def _down(self, has: np.ndarray, rest: np.ndarray, total: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Request, place of the id, score of the k best templates of each request with scores from `least` on. A node is left where
        no set below can have that score; `least` rises as templates are found."""
        width, n = len(self.codes), len(total)
        found, waiting = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0
        stack = [(0, np.arange(n), np.zeros(n, np.int64), np.full(n, len(self.levels[0]["code"])), np.zeros(n))] if self.levels else []

        def settle() -> None:
            nonlocal found, waiting
            who, place, score = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((place, -score, who))
            order = order[np.arange(len(who)) - np.searchsorted(who[order], who[order]) < k]
            who, score = who[order], score[order]
            found, waiting = [(who, place[order], score)], 0
            last = np.bincount(who, minlength=n).cumsum()[np.bincount(who, minlength=n) >= k] - 1
            least[who[last]] = np.maximum(least[who[last]], score[last])

        while stack:
            depth, q, lo, hi, s = stack.pop()
            many = hi - lo
            if (all_ := int(many.sum())) > NODES and len(q) > 1:
                half = len(q) // 2
                stack += [(depth, q[half:], lo[half:], hi[half:], s[half:]), (depth, q[:half], lo[:half], hi[:half], s[:half])]
                continue
            level = self.levels[depth]
            self.looked += all_
            node = np.repeat(lo - many.cumsum() + many, many) + np.arange(all_)
            q, s = np.repeat(q, many), np.repeat(s, many)
            cell = q * width + level["code"][node]
            s = s + has.take(cell)
            adds = np.minimum(rest.take(cell), level["adds"][node])
            most = s + adds
            with np.errstate(invalid="ignore"):
                can = (most > 0) & (UNIT * most / (total[q] + np.maximum(level["least"][node], level["way"][node] + adds) - most) >= least[q])
            q, node, s = q[can], node[can], s[can]
            ends = np.flatnonzero((level["set"][node] >= 0) & (s > 0))
            if len(ends):
                score = np.floor(UNIT * s[ends] / (total[q[ends]] + level["way"][node[ends]] - s[ends]))
                ends, score = ends[good := score >= least[q[ends]]], score[good]
                which = level["set"][node[ends]]
                keys = self.many[which]
                at = np.repeat(self.first[which] + keys - keys.cumsum(), keys) + np.arange(keys.sum())
                found.append((np.repeat(q[ends], keys), self.place[at], np.repeat(score, keys)))
                if (waiting := waiting + len(at)) > FOUND:
                    settle()
            lo, hi = level["child"][node], level["child"][node + 1]
            if (more := hi > lo).any():
                stack.append((depth + 1, q[more], lo[more], hi[more], s[more]))
        settle()
        return found[0]

    def best(self, codes: np.ndarray, many: np.ndarray, total: np.ndarray, floor: np.ndarray, k: int, slice_: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Request, id's place and score of the k best; `floor`, the score a request's template needs, rises to that of the k-th."""
        width = len(self.codes)
        at = np.minimum(np.searchsorted(self.codes, codes), max(width - 1, 0))
        in_it = self.codes[at] == codes if width else np.zeros(len(codes), bool)
        row = np.repeat(np.arange(len(many)), many)
        row, at = row[in_it], at[in_it]
        some = np.unique(row)
        step = max(1, min(slice_, CELLS // max(width, 1)))
        for lo in range(0, len(some), step):
            todo = some[lo : lo + step]
            for level in LEVELS:
                mine = np.full(len(many), -1)
                mine[todo] = np.arange(len(todo))
                here = mine[row] >= 0
                has = np.zeros((len(todo), width))
                has[mine[row[here]], at[here]] = self.weights[at[here]]
                rest = has.sum(axis=1)[:, None] - has.cumsum(axis=1)
                least = np.maximum(float(level), floor[todo])
                who, place, score = self._down(has.ravel(), rest.ravel(), total[todo], least, k)
                count = np.bincount(who, minlength=len(todo))
                done = (count >= k) | (floor[todo] >= level) | (level == LEVELS[-1])
                keep = done[who]
                full = count >= k
                floor[todo[full]] = np.maximum(floor[todo[full]], least[full])
                yield todo[who[keep]], place[keep], score[keep]
                todo = todo[~done]
                if len(todo) == 0:
                    break


def _match(requests: DataFrame, templates: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """request_id, codes, total of every request; codes, total, rank, template_id, score of the k best templates of the different sets."""
    places = max(8, PLACES * requests.sparkSession.sparkContext.defaultParallelism)
    t = kept(templates.select("template_id", "intent").dropna().distinct(), "templates")
    number = F.row_number().over(W.orderBy(F.desc("w"), "intent"))  # one row an intent
    codes = kept(intent_weights(t).withColumn("code", number), "codes")
    alone = t.select("template_id").distinct().agg(F.floor(UNIT * (1 + F.log(F.greatest(F.count("*"), F.lit(1))))).cast("bigint").alias("alone"))  # one row
    alone = kept(alone, "alone")
    asked = kept(_coded(requests.select("request_id", "intent"), "request_id", codes, alone).drop("ws"), "requests")

    nth = F.row_number().over(W.partitionBy("codes").orderBy("template_id"))
    sets = _coded(t, "template_id", codes, alone).withColumn("nth", nth).filter(F.col("nth") <= k)
    sets = kept(sets.groupBy("codes").agg(F.first("ws").alias("ws"), F.first("total").alias("total"), F.sort_array(F.collect_list("template_id")).alias("keys")), "sets")
    size = sets.agg(F.count("*"), F.coalesce(F.sum(F.length("codes")), F.lit(0))).first()
    blocks = max(-(-size[0] // TEMPLATES), -(-size[1] // 4 // CODES), 1)
    held = kept(_packed(sets.repartition(blocks), ["codes", "ws", "total", "keys"], TEMPLATES, CODES).withColumn("no", F.monotonically_increasing_id()), "template-blocks")
    numbers = sorted(x["no"] for x in held.select("no").collect())  # one a block
    different = asked.filter(F.length("codes") > 0).select("codes", "total").distinct()
    asks = _packed(different, ["codes", "total"], REQUESTS, CODES).withColumn("ask", F.monotonically_increasing_id())
    asks = asks.withColumn("place", F.expr(f"cast(pmod(shiftright(ask, 33) * 7919 + (ask & {2**33 - 1}), {places}) as int)")).withColumn("no", F.explode(F.array(*map(F.lit, numbers)) if numbers else F.array().cast("array<bigint>")))
    asks = asks.select("place", "no", "ask", F.col("block").alias("asks"), F.lit(None).cast(held.schema["block"].dataType).alias("block"))
    held = held.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(places - 1)))).select("place", "no", F.lit(-1).cast("bigint").alias("ask"), F.lit(None).cast(asks.schema["asks"].dataType).alias("asks"), "block")
    out = T.StructType([*different.schema.fields, T.StructField("template_id", t.schema["template_id"].dataType), T.StructField("score", T.LongType())])
    arrow = to_arrow_schema(out)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, floors = None, {}  # by block of requests, also from earlier blocks of templates
        for batch in batches:
            for i in range(batch.num_rows):
                if (ask := batch.column(2)[i].as_py()) < 0:
                    tree = None
                    tree = _Tree(batch.column(4)[i].values)
                    continue
                block = batch.column(3)[i].values
                numbers, many = _numbers(block.field("codes"), ">u4")
                floor = floors.setdefault(ask, np.full(len(block), -1.0))
                for who, place, score in tree.best(numbers, many, block.field("total").to_numpy().astype(np.float64), floor, k, SLICE):
                    if len(who):
                        who = pa.array(who)
                        yield pa.RecordBatch.from_arrays([block.field("codes").take(who), block.field("total").take(who), tree.ids.take(pa.array(tree.by_place[place])), pa.array(score.astype(np.int64))], schema=arrow)

    pairs = asks.unionByName(held).repartitionById(places, F.col("place")).sortWithinPartitions("no", "ask")
    best = W.partitionBy("codes", "total").orderBy(F.desc("score"), "template_id")
    found = pairs.mapInArrow(met, out).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return asked, kept(found, "found")


def match_templates(requests: DataFrame, templates: DataFrame, k: int = 3, lead: float = 0.5) -> DataFrame:
    """request_id, rank, template_id, score of each request's k best templates, from (request_id, intent) and (template_id, intent).

    The score is the weight of the intents that both have by the weight of those that either has, in whole millionths; an intent that no
    template has weighs as much as one that a single template has. Templates that share no intent aren't
    candidates; nulls and repeated intents count for nothing. Ties go by template_id.

    Requests of equal sets of intents are one, and of templates with equal sets only the first k can be among the best; so the work
    goes by different sets. A block of templates is a tree of their sorted intents, rare ones first. Blocks of requests go down the
    tree in tasks, for scores of `LEVELS` one after the other, and leave a node as soon as no set below can have the score; a request is done
    when k templates are found. The worst case is still each request against each template. `lead`, of an earlier way, has no effect."""
    asked, found = _match(requests, templates, k)
    return asked.filter(F.col("request_id").isNotNull()).join(found, ["codes", "total"]).select("request_id", "rank", "template_id", "score")


def band_requests(requests: DataFrame, templates: DataFrame, least: float = 0.5) -> DataFrame:
    """What best_match says of match_templates, from one pass over the requests and with one template for each."""
    asked, found = _match(requests, templates, 1)
    found = found.withColumn("score", F.col("score") / UNIT).filter(F.col("score") >= least).select("codes", "total", "template_id", "score")
    x = asked.join(found, ["codes", "total"], "left").select("request_id", "template_id", "score")
    return x.withColumn("band", template_band(F.coalesce("score", F.lit(0.0))))


def best_match(requests: DataFrame, matches: DataFrame, least: float = 0.5) -> DataFrame:
    """request_id, template_id, score, band of every request: the best template, null below `least`; from 0.8 on a shortcut, else a
    hint for the decomposition."""
    first = matches.filter("rank = 1").withColumn("score", F.col("score") / UNIT).filter(F.col("score") >= least).select("request_id", "template_id", "score")
    x = requests.select("request_id").distinct().join(first, "request_id", "left")
    return x.withColumn("band", template_band(F.coalesce("score", F.lit(0.0))))
