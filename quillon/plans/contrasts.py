"""Queries over contrastive tasks: B1 to B7 against the same draws in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tasks as T
from .registry import query
from .views import ITEMS, items

SEED, REQUESTS = 11, 200


def _n(*parts: str) -> str:
    return f"CAST(concat('0x', substr(md5(concat_ws('|', '{SEED}', {', '.join(parts)})), 1, 8)) AS BIGINT)"


def _sql(task: T.Task) -> str:
    name = task.name
    slots = ", ".join(f"({j}, {m}, {s})" for j, (m, s) in enumerate(task.slots))
    at = lambda j: f"max(CASE WHEN slot = {j} THEN place END)"
    same = f"{_n(repr(name), 'CAST(i AS VARCHAR)', repr('same'))} < {2**31}"
    answer = {
        "b1": f"chr(CAST(65 + {at(0)} AS INTEGER))",
        "b2": f"chr(CAST(65 + {at(len(task.slots) - 1)} AS INTEGER))",
        "b3": f"chr(CAST(65 + {_n(repr(name), 'CAST(i AS VARCHAR)', repr('corrupt'))} % {len(task.slots)} AS INTEGER))",
        "b4": f"chr(CAST(64 + {at(1)} AS INTEGER))",
        "b5": f"CASE WHEN {same} THEN 'same' ELSE 'different' END",
        "b6": f"chr(CAST(65 + least({at(0)}, {at(1)}) AS INTEGER)) || ' ' || chr(CAST(65 + greatest({at(0)}, {at(1)}) AS INTEGER))",
        "b7": f"chr(CAST(64 + {at(1)} AS INTEGER))",
    }[name]
    kept = f"WHERE slot = 0 OR slot = CASE WHEN {same} THEN 1 ELSE 2 END" if name == "b5" else ""
    return f"""WITH {ITEMS}, sized AS (SELECT space, label, count(*) AS n_items FROM items GROUP BY 1, 2 HAVING count(*) >= {task.items}),
l0 AS (SELECT *, count(*) OVER (PARTITION BY space) AS n_labels FROM sized),
l AS (SELECT *, row_number() OVER (PARTITION BY space ORDER BY md5(concat_ws('|', '{SEED}', 'label', space, label)), label) - 1 AS label_rank FROM l0 WHERE n_labels >= {task.labels}),
sp AS (SELECT space, any_value(n_labels) AS n_labels, row_number() OVER (ORDER BY space) - 1 AS space_rank, count(*) OVER () AS n_spaces FROM l GROUP BY space),
r AS (SELECT items.space, items.label, image, n_items, label_rank, row_number() OVER (PARTITION BY items.space, items.label ORDER BY md5(concat_ws('|', '{SEED}', 'item', CAST(image AS VARCHAR))), image) - 1 AS item_rank FROM items JOIN l ON items.space = l.space AND items.label = l.label),
q AS (SELECT i, {_n(repr(name), 'CAST(i AS VARCHAR)', repr('space'))} AS hs, {_n(repr(name), 'CAST(i AS VARCHAR)', repr('label'))} AS hl, {_n(repr(name), 'CAST(i AS VARCHAR)', repr('other'))} AS ho FROM (SELECT unnest(range(0, {REQUESTS})) AS i)),
p AS (SELECT i, space, n_labels, hl % n_labels AS target, ho % (n_labels - 1) AS other FROM q JOIN sp ON hs % n_spaces = space_rank),
s AS (SELECT * FROM (VALUES {slots}) v(slot, m, shift)),
e AS (SELECT i, space, slot, shift, CASE WHEN m = 0 THEN target ELSE (target + 1 + (other + m - 1) % (n_labels - 1)) % n_labels END AS label_rank FROM p, s),
z AS (SELECT e.*, n_items FROM e JOIN (SELECT DISTINCT space, label_rank, n_items FROM r) d ON e.space = d.space AND e.label_rank = d.label_rank),
f AS (SELECT i, z.space, slot, image, label FROM z JOIN r ON z.space = r.space AND z.label_rank = r.label_rank AND r.item_rank = ({_n(repr(name), 'CAST(i AS VARCHAR)', repr('item'), 'CAST(z.label_rank AS VARCHAR)')} + shift) % z.n_items),
o AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY CASE WHEN slot < {task.fixed} THEN ' ' || lpad(CAST(slot AS VARCHAR), 3, '0') ELSE md5(concat_ws('|', '{SEED}', '{name}', CAST(i AS VARCHAR), 'order', CAST(slot AS VARCHAR))) END, slot) - 1 AS place FROM f)
SELECT i, space, string_agg(CAST(image AS VARCHAR), ',' ORDER BY place) AS images, string_agg(label, ',' ORDER BY place) AS labels, {answer} AS answer FROM o {kept} GROUP BY i, space"""


def _plan(task: T.Task):
    def plan(spark, folder):
        out = T.build(items(spark, folder), task, REQUESTS, SEED)
        return out.select("i", "space", F.array_join(F.transform("images", lambda x: x.cast("string")), ",").alias("images"), F.array_join("labels", ",").alias("labels"), "answer")

    return plan


for _name, _task in {"b1_target_search": T.target_search(4), "b2_odd_one_out": T.odd_one_out(4), "b3_label_corruption": T.label_corruption(4), "b4_exemplar_match": T.exemplar_match(4), "b5_same_different": T.same_different(), "b6_pair_finding": T.pair_finding(5), "b7_support_set": T.support_set(4)}.items():
    query(_name, _sql(_task))(_plan(_task))


@query("candidate_labels", f"""WITH {ITEMS}, pool AS (SELECT space, list_sort(list(DISTINCT label)) AS pool FROM items GROUP BY space),
e AS (SELECT image, label, x, row_number() OVER (PARTITION BY image ORDER BY md5(concat_ws('|', '{SEED}', CAST(image AS VARCHAR), x)), x) AS rk FROM (SELECT image, label, unnest(pool) AS x FROM items JOIN pool ON items.space = pool.space) WHERE x <> label),
c AS (SELECT image, x FROM e WHERE rk <= 3 UNION ALL SELECT image, label FROM items) SELECT image, string_agg(x, ',' ORDER BY x) AS candidates FROM c GROUP BY image""")
def candidate_labels(spark, folder):
    df = items(spark, folder)
    pool = df.groupBy("space").agg(F.array_sort(F.collect_set("label")).alias("pool"))
    return df.join(pool, "space").select("image", F.array_join(T.candidates(F.col("label"), F.col("pool"), 4, SEED, F.col("image")), ",").alias("candidates"))


@query("attribute_expansion", """WITH x AS (SELECT p_partkey, string_split(p_type, ' ') AS w FROM part) SELECT p_partkey, w[i] AS element, format('attr_{:06d}_{:02d}', p_partkey, i) AS id FROM (SELECT p_partkey, w, unnest(range(1, len(w) + 1)) AS i FROM x)""")
def attribute_expansion(spark, folder):
    from .views import table

    df = table(spark, folder, "part").select("p_partkey", F.split("p_type", " ").alias("w"))
    return T.expand(df, "w", "p_partkey", "attr").select("p_partkey", "element", "id")
