"""Order-dependent packing as a sharded fold.

Some groupings depend on history: a block joins the open chunk only while it still fits.  The fold
runs over rows clustered by (document_id, shard) and sorted, streaming through Arrow batches with
a state of one open group.  A document that spans several shards is handled in three steps, so
that no task ever sees more than one shard of it:

1. every shard reports, for each row near its start at which a new group might begin, the state and
   the number of groups at its end (once a group has begun, the past no longer matters);
2. these short reports are chained per document, which gives every shard its entry state;
3. every shard is folded once more from its known entry state.

Documents of one shard need only the last step. The rows are written once before, as all steps read them: the first two only the
narrow columns of the fold, the last one the whole rows. So what leads to the rows is computed once, however folds follow on folds.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.session import stored

# row kinds
PLAIN, TITLE, ALONE, FOLLOW = 0, 1, 2, 3  # FOLLOW rows stay with the row before them

NOTHING = (-1, None)  # no group can be joined


class PackChunks:
    """Blocks to chunks: a title starts a chunk, a table or over-long block stands alone."""

    carries_label = True

    def __init__(self, target: int):
        self.target = target

    def fresh(self, size, kind, tag):
        return NOTHING if kind == ALONE else (size, None)

    def joins(self, state, size, kind, tag):
        return kind == PLAIN and state[0] >= 0 and state[0] + size <= self.target

    def restarts_always(self, before, size, kind, tag):
        return kind != PLAIN or before + size > self.target


class MergeShort:
    """Neighbouring short drafts of one section; a merged draft stops growing at the minimum."""

    carries_label = False

    def __init__(self, minimum: int):
        self.minimum = minimum

    def fresh(self, size, kind, tag):
        return (size, tag) if kind == PLAIN and size < self.minimum else NOTHING

    def joins(self, state, size, kind, tag):
        return kind == PLAIN and 0 <= state[0] < self.minimum and size < self.minimum and state[1] == tag

    def restarts_always(self, before, size, kind, tag):
        return kind != PLAIN or size >= self.minimum or before >= self.minimum


class GroupChunks:
    """Chunks to summary groups: a hard size limit, and title changes once a group is nearly full."""

    carries_label = False

    def __init__(self, limit: int, minimum: int):
        self.limit, self.minimum = limit, minimum

    def fresh(self, size, kind, tag):
        return (size, tag)

    def joins(self, state, size, kind, tag):
        return (
            state[0] >= 0 and state[0] + size <= self.limit
            and not (tag != state[1] and state[0] >= self.minimum)
        )

    def restarts_always(self, before, size, kind, tag):
        return before + size > self.limit


def _advance(rule, state, size, kind, tag):
    """One row: (a new group began, next state)."""
    if rule.joins(state, size, kind, tag):
        return False, (state[0] + size, state[1])
    return True, rule.fresh(size, kind, tag)


def _report(rule, rows):
    """What one shard tells about itself: its first rows and the end reached from each of them."""
    head = len(rows)
    before = 0
    for i, (size, kind, tag, _) in enumerate(rows):
        if rule.restarts_always(before, size, kind, tag):
            head = i + 1
            break
        before += size
    ends = [None] * len(rows)

    def end_from(i):
        """State and group count at the shard end when a group begins at row i."""
        path = []
        while i is not None and ends[i] is None:
            size, kind, tag, weight = rows[i]
            state, j = rule.fresh(size, kind, tag), i + 1
            while j < len(rows):
                new, nxt = _advance(rule, state, *rows[j][:3])
                if new:
                    break
                state, j = nxt, j + 1
            path.append((i, weight, state))
            i = j if j < len(rows) else None
        for at, weight, state in reversed(path):
            if i is None:
                ends[at] = (*state, weight)
            else:
                ends[at] = (ends[i][0], ends[i][1], ends[i][2] + weight)
            i = at
        return ends[path[0][0]] if path else ends[i]

    exits = [end_from(i) for i in range(head)]
    labels = [r[2] for r in rows if r[1] == TITLE]
    return [r[0] for r in rows[:head]], [r[1] for r in rows[:head]], [r[2] for r in rows[:head]], exits, (labels or [None])[-1]


def _runs(batches, columns):
    """Consecutive rows of each (document, shard) in a sorted stream of batches."""
    key, rows = None, []
    for batch in batches:
        for doc, shard, *row in zip(*(batch.column(c).to_pylist() for c in columns)):
            if (doc, shard) != key:
                if rows:
                    yield key, rows
                key, rows = (doc, shard), []
            if row[1] != FOLLOW:
                rows.append(tuple(row))
    if rows:
        yield key, rows


_ITEM = ["document_id", "shard", "item_size", "item_kind", "item_tag", "item_weight"]
_REPORT = pa.schema(
    [
        ("document_id", pa.int64()), ("shard", pa.int64()), ("sizes", pa.list_(pa.int64())),
        ("kinds", pa.list_(pa.int32())), ("tags", pa.list_(pa.string())), ("end_sizes", pa.list_(pa.int64())),
        ("end_tags", pa.list_(pa.string())), ("end_groups", pa.list_(pa.int64())), ("label", pa.string()),
    ]
)
_REPORT_DDL = (
    "document_id long, shard long, sizes array<long>, kinds array<int>, tags array<string>, "
    "end_sizes array<long>, end_tags array<string>, end_groups array<long>, label string"
)
_ENTRY = pa.schema(
    [("document_id", pa.int64()), ("shard", pa.int64()), ("in_size", pa.int64()), ("in_tag", pa.string()),
     ("in_groups", pa.int64()), ("in_label", pa.string())]
)
_ENTRY_DDL = "document_id long, shard long, in_size long, in_tag string, in_groups long, in_label string"


def _together(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of a key in one task.

    Spark leaves out a shuffle on the columns that a join before it already used, and may then read that join's input in
    another way, as what follows here asks for no clustering that Spark knows of; a hash of the columns is not left out.
    """
    return df.repartition(F.xxhash64(*keys))


def _entry_states(df: DataFrame, order, rule) -> DataFrame:
    """Entry state of every shard of the documents that span several shards."""
    wide = df.filter("shard > 0").select("document_id").distinct()
    items = df.select(*dict.fromkeys([*_ITEM, *order])).join(wide, "document_id", "left_semi")

    def report(batches):
        for (doc, shard), rows in _runs(batches, _ITEM):
            sizes, kinds, tags, exits, label = _report(rule, rows)
            row = [doc, shard, sizes, kinds, tags, [e[0] for e in exits], [e[1] for e in exits], [e[2] for e in exits], label]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _REPORT)], schema=_REPORT)

    reports = (
        _together(items, "document_id", "shard").sortWithinPartitions("document_id", "shard", *order)
        .mapInArrow(report, _REPORT_DDL)
    )

    def chain(table: pa.Table) -> pa.Table:
        """Carry the state through the reports of one document, shard by shard."""
        out = []
        state, groups, label = NOTHING, 0, None
        for r in table.sort_by("shard").to_pylist():
            out.append((r["document_id"], r["shard"], state[0], state[1], groups, label))
            for i, item in enumerate(zip(r["sizes"], r["kinds"], r["tags"])):
                new, nxt = _advance(rule, state, *item)
                if new:
                    state = (r["end_sizes"][i], r["end_tags"][i])
                    groups += r["end_groups"][i]
                    break
                state = nxt
            label = r["label"] if r["label"] is not None else label
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ENTRY)], schema=_ENTRY)

    return reports.groupBy("document_id").applyInArrow(chain, _ENTRY_DDL)


def fold(df: DataFrame, order: list[str], rule, group: str, label: str | None = None) -> DataFrame:
    """Number the groups of every document in order (from 0), as column `group`.

    `df` carries document_id, shard, item_size, item_kind, item_tag and item_weight (how many group
    numbers the row takes).  `label` names an extra column with the last title seen.
    """
    df = stored(df)
    # entry states are rows before the first row of their shard, so that no join moves the whole rows beside the fold's own shuffle
    entries = _entry_states(df, order, rule).filter("shard is not null")
    rows = df.unionByName(entries, allowMissingColumns=True)
    columns = [*_ITEM, "in_size", "in_tag", "in_groups", "in_label"]
    kept = ["document_id", "shard", *[c for c in df.columns if c not in columns]]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema.fields)
    ddl = f"{fields}, {group} long" + (f", {label} string" if label else "")

    def run(batches):
        key = state = None
        groups, taken, last = 0, 0, None
        for batch in batches:
            numbers, labels = [], []
            for doc, shard, size, kind, tag, weight, in_size, in_tag, in_groups, in_label in zip(
                *(batch.column(c).to_pylist() for c in columns)
            ):
                if (doc, shard) != key:
                    key, state = (doc, shard), NOTHING
                    groups, taken, last = 0, -1, None
                if in_groups is not None:
                    state, groups, last = (in_size, in_tag), in_groups, in_label
                    taken = groups - 1  # the group that is open on entry
                    continue
                if kind != FOLLOW:
                    new, state = _advance(rule, state, size, kind, tag)
                    if new:
                        taken = groups
                        groups += weight
                    if kind == TITLE:
                        last = tag
                numbers.append(taken)
                labels.append(last)
            batch = batch.filter(batch.column("in_groups").is_null())
            arrays = [batch.column(c) for c in kept] + [pa.array(numbers, pa.int64())]
            names = [*kept, group]
            if label:
                arrays.append(pa.array(labels, pa.string()))
                names.append(label)
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    placed = _together(rows, "document_id", "shard").sortWithinPartitions("document_id", "shard", F.col("in_groups").isNull(), *order)
    return placed.mapInArrow(run, ddl)
