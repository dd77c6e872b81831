"""Scorers as column builders: a response and its ground truth in, a struct of numbers out; and a registry of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X

# Rewards for a right, a wrong and an unreadable answer.
RIGHT, WRONG, UNREADABLE = 2.0, -1.5, -0.5

SCORERS: dict[str, Callable[..., Column]] = {}


def scorer(name: str):
    def register(f: Callable[..., Column]) -> Callable[..., Column]:
        SCORERS[name] = f
        return f

    return register


def score(name: str, *columns: Column, **options) -> Column:
    """A registered scorer by name; only registered ones can run."""
    if name not in SCORERS:
        raise ValueError(f"no scorer is named {name}; there are {', '.join(sorted(SCORERS))}")
    return SCORERS[name](*columns, **options)


def _result(overall: Column, **more: Column) -> Column:
    return F.struct(overall.cast("double").alias("overall"), *[c.cast("double").alias(k) for k, c in more.items()])


@scorer("discrete")
def discrete(response: Column, gold: Column) -> Column:
    """Letter, pair or same/different answers (R-01, R-02)."""
    truth = X.collapse(gold)
    kind = X.answer_kind(truth)
    predicted = F.when(kind == "letter", X.single_letter(response)).when(kind == "pair", X.letter_pair(response)).when(kind == "same_different", X.same_different(response))
    wanted = F.when(kind == "letter", F.upper(truth)).when(kind == "pair", F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(F.upper(truth), F.lit("[A-Z]"), F.lit(0)))), " ")).otherwise(F.lower(truth))
    right = predicted == wanted
    return _result(F.when(predicted.isNull(), UNREADABLE).when(right, RIGHT).otherwise(WRONG), acc=F.coalesce(right, F.lit(False)).cast("int"))


@scorer("stepwise")
def stepwise(response: Column, gold: Column, labels: Column) -> Column:
    """discrete, plus up to 1 for the share of images whose label is given right (R-03); labels by letter order."""
    found = X.label_map(response)
    hits = F.filter(F.transform(labels, lambda x, i: F.coalesce(X.alnum(found[F.chr(65 + i)]) == X.alnum(x), F.lit(False))), lambda h: h)
    bonus = F.when(F.size(labels) > 0, F.size(hits) / F.size(labels)).otherwise(0.0)
    base = discrete(response, gold)
    return _result(base["overall"] + bonus, acc=base["acc"], bonus=bonus)


@scorer("label")
def label(response: Column, gold: Column, aliases: dict[str, str], candidates: Column | None = None, aliases_first: bool = False) -> Column:
    """Free-text labels compared by canonical name (R-04, R-05)."""
    span = X.answer_span(response)
    predicted = X.canonical_label(span, aliases, candidates, aliases_first)
    wanted = F.coalesce(X.canonical_label(gold, aliases, candidates, aliases_first), X.alnum(gold, "image"))
    return _result(F.when(predicted.isNull(), UNREADABLE).when(predicted == wanted, RIGHT).otherwise(WRONG), acc=F.coalesce(predicted == wanted, F.lit(False)).cast("int"))


@scorer("mixed")
def mixed(response: Column, gold: Column, labels: Column, aliases: dict[str, str], candidates: Column) -> Column:
    """label where the row has candidates, else stepwise (R-06)."""
    free, lettered = label(response, gold, aliases, candidates, True), stepwise(response, gold, labels)
    has = F.coalesce(F.size(candidates), F.lit(0)) > 0
    return F.when(has, F.struct(free["overall"].alias("overall"), free["acc"].alias("acc"))).otherwise(F.struct(lettered["overall"].alias("overall"), lettered["acc"].alias("acc")))


def list_score(predicted: Column, gold: Column, mode: str) -> Column:
    """f1, exact, recall, precision or jaccard of two lists by answer key (U-05, U-06)."""
    p_all, g_all = F.transform(predicted, X.answer_key), F.transform(gold, X.answer_key)
    p, g = (F.array_distinct(F.filter(a, lambda k: k != "")) for a in (p_all, g_all))
    both = F.size(F.array_intersect(p, g)).cast("double")
    value = {"exact": (p_all == g_all).cast("double"), "recall": F.try_divide(both, F.size(g)), "precision": F.try_divide(both, F.size(p)), "jaccard": F.try_divide(both, F.size(F.array_union(p, g))), "f1": F.try_divide(2 * both, F.size(p) + F.size(g))}[mode]
    empty = F.size(gold) == 0 if mode == "exact" else (F.size(p) == 0) | (F.size(g) == 0)
    return F.when(empty, 0.0).otherwise(F.coalesce(value, F.lit(0.0)))


@scorer("offline")
def offline(response: Column, gold: Column, kind: Column, aliases: dict[str, str], candidates: Column, mode: str = "f1") -> Column:
    """Yes/no, list, label and text answers by their kind: bool, list, cls or text (R-07)."""
    span = X.answer_span(response)
    spelled = lambda x: F.coalesce(X.option_lookup(x, candidates), x)
    flag = F.coalesce(X.yes_no(span) == X.yes_no(gold), F.lit(False)).cast("double")
    listed = list_score(F.transform(X.list_items(span), spelled), F.transform(X.list_items(gold), spelled), mode)
    name = lambda x: F.coalesce(X.canonical_label(x, aliases, candidates), X.alnum(x, "image"))
    plain = ((X.answer_key(span) == X.answer_key(gold)) & (X.answer_key(span) != "")).cast("double")
    acc = F.when(kind == "bool", flag).when(kind == "list", listed).when(kind == "cls", (name(span) == name(gold)).cast("double")).otherwise(plain)
    return _result(acc, acc=acc, correct=(acc >= 0.999).cast("int"))


@scorer("keywords")
def keywords(response: Column, gold: Column, words: Column) -> Column:
    """Text equality plus a keyword bonus (R-08)."""
    span = X.answer_span(response)
    equal = (X.answer_key(span) == X.answer_key(gold)).cast("double")
    return _result(equal + X.keyword_bonus(response, words), acc=equal)


@scorer("direct")
def direct(response: Column, gold: Column) -> Column:
    """Same/different, one letter, two letters in any order, else text equality (R-09, R-10)."""
    predicted = X.answer_span(response, colon=True)
    tokens = lambda x: F.filter(F.transform(F.regexp_extract_all(x, F.lit("[A-Za-z0-9_]+"), F.lit(0)), F.upper), lambda t: t.rlike("^[A-Z]$"))
    p, g, key = tokens(predicted), tokens(gold), X.answer_key_late_quotes
    right = (
        F.when((predicted == "") | (X.strip(gold) == ""), False)
        .when(key(gold).isin("same", "different"), key(predicted) == key(gold))
        .when(F.size(g) == 1, F.coalesce(F.get(p, F.lit(0)) == F.get(g, F.lit(0)), F.lit(False)))
        .when(F.size(g) == 2, F.array_sort(F.slice(p, 1, 2)) == F.array_sort(g))
        .otherwise(key(predicted) == key(gold))
    )
    return _result(right.cast("int"), accuracy=right.cast("int"))


@scorer("equality")
def equality(response: Column, gold: Column, format_weight: float = 0.0) -> Column:
    """Text equality, with a share for a tagged form (R-11, R-12, R-23)."""
    acc = (X.answer_key_late_quotes(X.answer_span(response, colon=True)) == X.answer_key_late_quotes(gold)).cast("double")
    form = X.tagged(response).isNotNull().cast("double")
    return _result(acc * (1 - format_weight) + form * format_weight, accuracy=acc, format=form)


@scorer("math")
def math(response: Column, gold: Column, format_weight: float = 0.1) -> Column:
    """Boxed answers by their text, with a share for the form (R-13, R-14); symbolic equality is out of scope."""
    acc = F.coalesce(X.collapse(X.boxed(response)) == X.collapse(gold), F.lit(False)).cast("double")
    form = X.well_formed(response)
    return _result(acc * (1 - format_weight) + form * format_weight, accuracy=acc, format=form)


@scorer("tail")
def tail(response: Column, gold: Column, length: Column, most: int, buffer: int, window: int = 300) -> Column:
    """+1 or -1 by the last answer of the last ``window`` characters, plus the penalty for length (R-15)."""
    last = F.try_element_at(F.regexp_extract_all(F.right(response, F.lit(window)), F.lit(r"(?i)answer\s*:\s*([^\n]+)"), F.lit(1)), F.lit(-1))
    right = F.coalesce(X.answer_key(last) == X.answer_key(gold), F.lit(False))
    penalty = X.overlong_penalty(length, most, buffer)
    return _result(F.when(right, 1.0).otherwise(-1.0) + penalty, accuracy=right.cast("int"), overlong=penalty)


def _diagnosis(response: Column, ambiguous: list[str], names: list[str]) -> tuple[Column, Column]:
    t, alternatives = F.lower(response), "|".join(names)
    doubtful = t.rlike("|".join(ambiguous))
    given = F.coalesce(F.nullif(F.regexp_extract(t, rf"<answer>\s*({alternatives})\s*</answer>", 1), F.lit("")), F.nullif(F.regexp_extract(t, rf"answer\s*[:=]\s*({alternatives})", 1), F.lit("")), F.lit("unknown"))
    return doubtful, given


@scorer("confidence")
def confidence(response: Column, gold: Column, ambiguous: list[str], names: list[str], alpha: float = 0.5, beta: float = 0.5, loss: float = 2.0, cost: float = 0.1) -> Column:
    """alpha + beta * confidence - cost when right, -loss * confidence - cost when wrong, 0 when unsure (R-18..R-22)."""
    doubtful, given = _diagnosis(response, ambiguous, [*names, "unsure"])
    unsure = doubtful | given.isin("unsure", "unknown")
    sure = F.coalesce(F.when(~unsure, X.confidence(response)), F.lit(0.0))
    right = ~unsure & (given == F.lower(gold))
    overall = F.when(unsure, 0.0).when(right, alpha + beta * sure - cost).otherwise(-loss * sure - cost)
    return _result(overall, acc=right.cast("int"), unsure=unsure.cast("int"), answered=(~unsure).cast("int"), confidence=sure)


@scorer("verdict")
def verdict(response: Column, gold: Column, ambiguous: list[str], names: list[str], right: float = 1.5, wrong: float = -1.0, silent: float = -1.5) -> Column:
    """``right`` or ``wrong`` for a committed answer, ``silent`` for an ambiguous text or none of the names (R-18)."""
    doubtful, given = _diagnosis(response, ambiguous, names)
    hit = given == F.lower(gold)
    return _result(F.when(doubtful | (given == "unknown"), silent).when(hit, right).otherwise(wrong), acc=hit.cast("int"), ambiguous=doubtful.cast("int"))


@scorer("structure")
def structure(response: Column, gold: Column, ambiguous: list[str], names: list[str], weights: dict[str, float], most: float = 1.0) -> Column:
    """Correctness plus capped weights for sections and features that are named (R-16, R-17)."""
    doubtful, given = _diagnosis(response, ambiguous, names)
    right = ~doubtful & (given == F.lower(gold))
    extra = F.least(F.lit(most), X.weighted_hits(response, weights))
    return _result(F.when(right, 1.0).otherwise(0.0) + extra, acc=right.cast("int"), structure=extra)


@scorer("choice")
def choice(response: Column, gold: Column) -> Column:
    """Digit choices (R-24)."""
    right = F.coalesce(X.digit_choice(response) == X.strip(gold), F.lit(False))
    return _result(right.cast("int"), accuracy=right.cast("int"))


@scorer("logic")
def logic(response: Column, include: Column, exclude: Column, avoid: Column) -> Column:
    """+1 with every demanded phrase, -1.5 with an excluded one, -0.5 more for one to be avoided in the thinking part, else -1 (R-25)."""
    thought = F.coalesce(X.tagged(response, "think"), F.lit(""))
    answer = F.regexp_replace(response, "(?is)<think>.*?</think>", "")
    has, bad, slip = (F.size(include) > 0) & X.contains_all(answer, include), X.contains_any(answer, exclude), X.contains_any(thought, avoid)
    overall = F.when(bad, -1.5).when(has, 1.0).otherwise(-1.0) + F.when(slip, -0.5).otherwise(0.0)
    return _result(overall, accuracy=(has & ~bad).cast("int"))


@scorer("final")
def final(response: Column, gold: Column) -> Column:
    """The final answer of a two-stage record (R-27): letters and pairs by their canonical form, else text."""
    return direct(response, gold)
