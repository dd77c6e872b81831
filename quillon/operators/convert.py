"""Rows from one layout into another: few-shot exports, base rows, answers, fold samples, schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import lookup

# The sentence that asks for no reasoning, which few-shot exports end in.
NO_REASONING = r"(?is)\s*(?:please\s+)?(?:answer|respond|reply)\s+directly.*$"


def offline_row(problem: Column, label: Column, image: Column, tail: str | None = NO_REASONING, wrap: str | None = None) -> Column:
    """A few-shot row as an offline row: candidates are read from the text; the tail goes, or the text is wrapped (P-09)."""
    bare = F.regexp_replace(problem, tail, "") if tail else problem
    prompt = F.replace(F.lit(wrap), F.lit("{problem}"), bare) if wrap else bare
    answer = F.struct(F.lit("cls").alias("task_type"), F.lit("label").alias("answer_type"), X.collapse(label).alias("correct_answer"), X.bracket_list(problem).alias("candidate_labels"))
    return F.struct(X.strip(prompt).alias("prompt"), F.array(image).alias("images"), answer.alias("answer"))


def base_row(ident: Column, label: Column, image: Column, dataset: str, task: str = "classification") -> Column:
    """A few-shot row as a base row: no options, one task (P-10)."""
    none = F.lit(None).cast("string")
    options = [none.alias(f"option_{c}") for c in "ABCD"]
    return F.struct(F.lit(dataset).alias("dataset"), F.concat_ws("-", F.lit(dataset), ident.cast("string")).alias("question_id"), F.lit(task).alias("question_type"), image.alias("image_path"), X.clean_label(label).alias("gt_answer"), *options)


def rebuilt(few: DataFrame, corpus: DataFrame, key: str, mark: str, want: str, options: list[str], truth: str) -> DataFrame:
    """Few-shot rows as lettered questions with the options of the corpus row they match (P-12); ``status`` says which did."""
    found = lookup.disambiguated_by_value(few, corpus, key, mark, want)
    columns = [F.col(o) for o in options]
    return found.withColumn("answer_id", F.when(F.col("status") == "matched", fuzzy_letter(columns, F.col(truth)))).withColumn("prompt", F.when(F.col("status") == "matched", X.choice_prompt(F.col(truth), columns)))


def fuzzy_letter(options: list[Column], truth: Column, names: tuple[str, str] = ("benign", "malignant")) -> Column:
    """The letter of the only option equal to the truth, else of the only one that holds the one of two names that the truth holds (F-11)."""
    t = X.folded(truth)
    one, other = (F.contains(t, F.lit(n)) for n in names)
    name = F.when(one & ~other, names[0]).when(other & ~one, names[1])
    pairs = F.array(*[F.struct(F.lit(chr(65 + i)).alias("letter"), X.folded(o).alias("text")) for i, o in enumerate(options)])
    hits = F.filter(pairs, lambda p: F.coalesce(F.contains(p["text"], name), F.lit(False)))
    # a truth that several options equal has no exact letter and goes on to the names, as one that none equals
    return F.coalesce(X.answer_letter(options, truth), F.when(F.size(hits) == 1, F.get(hits, F.lit(0))["letter"]))


def answer_struct(answer: Column, image: Column, root: str) -> Column:
    """A scalar answer as a struct, and the image's path under ``root`` (P-14)."""
    path = F.when(image.isNull() | image.startswith("/"), image).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), image))
    return F.struct(F.struct(F.coalesce(answer.cast("string"), F.lit("")).alias("label")).alias("answer"), F.filter(F.array(path), lambda p: p.isNotNull()).alias("images"))


def fold_sample(image: Column, label: Column, prefix: str | None = None) -> Column:
    """A fold's sample: the path's last part, or that under a prefix (P-22)."""
    name = X.basename(image)
    return F.struct((F.concat(F.lit(prefix.rstrip("/") + "/"), name) if prefix else name).alias("image"), X.folded(label).alias("label"))


def nested(document: Column, path: str, default: str) -> Column:
    """The text at a dotted path of a JSON document, else the default (P-23)."""
    return F.coalesce(F.nullif(F.get_json_object(document, "$." + path), F.lit("")), F.lit(default))


def with_listing(df: DataFrame, listing: DataFrame, path: str, drop: bool) -> DataFrame:
    """``missing`` marks rows whose path isn't listed; they go only if ``drop`` (C-04)."""
    known = listing.select(F.col(path).alias("_path")).distinct()
    marked = df.join(known, F.col(path) == F.col("_path"), "left").withColumn("missing", F.col("_path").isNull()).drop("_path")
    return marked.where(~F.col("missing")) if drop else marked


def rewritten_where(task: Column, gate: str, value: Column, new: Column) -> Column:
    """Only rows of the gated task are rewritten (C-06)."""
    return F.when(F.coalesce(task == gate, F.lit(False)), new).otherwise(value)


def labelled(df: DataFrame, names: DataFrame, key: str, name: str) -> DataFrame:
    """Rows with the name of their numeric label; unknown numbers keep a null name (S-12)."""
    return df.join(names.select(key, name), key, "left")


def quota_cycle(quota: dict[str, int], order: list[str]) -> list[str]:
    """Each key as often as its quota, in order; blank keys and quotas below 1 give nothing."""
    return [k for k in order if k.strip() for _ in range(quota.get(k, 0))]


def schedule(batches: DataFrame, scopes: list[str], kinds: list[str], labels: list[str], size: int, batch: str = "batch") -> DataFrame:
    """``size`` targets for each batch 0, 1, ...: scope, answer type and, for the scope ``class``, a label (W-23).

    Batch b starts its cycles b places further. Labels follow each other over all class targets, so the place of a target's label is
    the number of class targets before it: whole batches by a closed form of the cycle, the rest within the batch.
    """
    n = len(scopes)
    per_turn = [sum(scopes[(offset + i) % n] == "class" for i in range(size)) for offset in range(n)]
    before = [sum(per_turn[:k]) for k in range(n + 1)]
    number = F.col(batch)
    earlier = F.floor(number / n) * before[n] + F.get(F.array(*[F.lit(x) for x in before]), F.pmod(number, F.lit(n)).cast("int"))
    rows = batches.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    of = lambda cycle, place: F.get(F.array(*[F.lit(x) for x in cycle]), F.pmod(place, F.lit(len(cycle))).cast("int"))
    rows = rows.withColumn("scope", of(scopes, number + F.col("slot"))).withColumn("answer_type", of(kinds, number + F.col("slot")))
    own = F.size(F.filter(F.sequence(F.lit(0), F.col("slot")), lambda i: of(scopes, number + i) == "class")) - 1
    return rows.withColumn("label", F.when(F.col("scope") == "class", of(labels, earlier + own)))


def block_range(total: Column, blocks: Column, index: Column) -> Column:
    """struct(begin, end) of a block of lines: equal blocks of the size rounded up, the last cut at the end (W-24)."""
    size = F.floor((total + blocks - 1) / blocks)
    return F.struct((index * size + 1).alias("begin"), F.least((index + 1) * size, total).alias("end"))


def single_image(question: Column, image: Column, label: Column) -> Column:
    """A task of one image (T-11)."""
    return F.struct(F.concat(F.lit("<image>\n"), X.collapse(question)).alias("prompt"), F.array(image).alias("images"), F.struct(F.lit("single").alias("task_type"), X.collapse(label).alias("correct_answer")).alias("answer"))


def comparative(rows: DataFrame, pools: dict[str, str], classes: list[str], images: int, seed: str, index: str = "i", strategy: str = "rotate") -> DataFrame:
    """A target of one class among distractors of the others, which cycle; drawn with replacement (T-12, T-13).

    rows holds ``index`` and, for each class, its pool as the array column that ``pools`` names. strategy: rotate, first or random. Draws
    are hashes of (seed, index, place); the shown order sorts by such a hash too. Adds target_class, images and correct_answer;
    without an image of the target class both of the latter are null.
    """
    draw = lambda what, place: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.lit(what), F.col(index).cast("string"), place.cast("string"))), 1, 8), 16, 10).cast("long")
    number = {"rotate": F.pmod(F.col(index), F.lit(len(classes))), "first": F.lit(0), "random": F.pmod(draw("class", F.lit(0)), F.lit(len(classes)))}[strategy]
    names = F.array(*[F.lit(c) for c in classes])
    bound = rows.withColumn("_t", number.cast("int")).withColumn("_pools", F.array(*[F.col(pools[c]) for c in classes]))
    # the others in the order of the class list, without the target
    rest = F.filter(F.sequence(F.lit(0), F.lit(len(classes) - 1)), lambda c: c != F.col("_t"))
    others = F.transform(F.sequence(F.lit(0), F.lit(images - 2)), lambda i: F.get(rest, F.pmod(i, F.lit(len(classes) - 1)).cast("int"))) if images > 1 else F.array().cast("array<int>")
    slots = F.transform(F.concat(F.array(F.col("_t")), others), lambda c, i: F.struct(c.cast("int").alias("c"), i.alias("i")))

    def filled(s: Column) -> Column:
        pool = F.get(F.col("_pools"), s["c"])
        at = F.pmod(draw("image", s["i"]), F.greatest(F.size(pool), F.lit(1))).cast("int")
        return F.struct(draw("order", s["i"]).alias("o"), s["i"].alias("i"), F.get(pool, at).alias("image"))

    shown = F.array_sort(F.filter(F.transform(slots, filled), lambda x: x["image"].isNotNull()))
    done = bound.withColumn("_shown", shown)
    place = F.array_position(F.transform("_shown", lambda x: x["i"]), F.lit(0)).cast("int")
    ok = place > 0
    return done.select(*rows.columns, F.get(names, F.col("_t")).alias("target_class"), F.when(ok, F.transform("_shown", lambda x: x["image"])).alias("images"), F.when(ok, F.chr(64 + place)).alias("correct_answer"))


def dedupe_json(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key, keys compared as canonical JSON; a null key is always unique (U-02).

    Canonical: object keys sorted, no white space, so two spellings of a value are one key. First by hash of the key, map-side, then a join.
    """
    # a variant sorts object keys; its JSON text is the canonical form
    canonical = F.coalesce(F.try_parse_json(F.col(key)).cast("string"), F.col(key))
    keyed = df.withColumn("_key", F.sha2(canonical, 256))
    first = keyed.where("_key is not null").groupBy("_key").agg(F.min(order).alias("_first"))
    kept = keyed.where("_key is not null").join(first, "_key").where(F.col(order) == F.col("_first")).drop("_first")
    return kept.unionByName(keyed.where("_key is null")).drop("_key")
