"""Text columns: normal forms, tokens, what a question is about."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from shelfmark.functions import phrases as P


def normal(text: Column) -> Column:
    """Lower case, everything but a-z and 0-9 as single blanks."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def words(text: Column) -> Column:
    """Runs of a-z and 0-9, lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def spoken_tokens(text: Column) -> Column:
    """Blank-separated tokens without surrounding punctuation, lower case, at least three characters."""
    parts = F.split(F.coalesce(text, F.lit("")), r"\s+")
    bare = F.transform(parts, lambda p: F.lower(F.regexp_replace(p, r"^[.,!?\-_/]+|[.,!?\-_/]+$", "")))
    return F.array_distinct(F.filter(bare, lambda t: F.length(t) >= 3))


def long_tokens(normal_text: Column) -> Column:
    """Tokens of at least three characters of a normal text; repeated ones count again."""
    return F.filter(F.split(normal_text, " "), lambda t: F.length(t) >= 3)


def has_phrase(text: Column, phrases: Sequence[str]) -> Column:
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(p)) for p in phrases])


def has_word(text: Column, terms: Sequence[str]) -> Column:
    return F.arrays_overlap(words(text), F.array(*[F.lit(t) for t in terms]))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))


def is_business_summary(text: Column) -> Column:
    return has_phrase(text, P.BUSINESS_SUMMARY_PHRASES)


def mentions_customers(text: Column) -> Column:
    return has_phrase(text, P.CUSTOMER_KEYWORDS)


def mentions_transactions(text: Column) -> Column:
    return has_phrase(text, P.TRANSACTION_KEYWORDS)


def asks_for_reasoning(text: Column) -> Column:
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return ~is_business_summary(text) & (has_phrase(text, P.REASONING_PHRASES) | lowered.rlike(P.REASONING_WORDS))


def intent(text: Column) -> Column:
    """One of nine, the first that applies."""
    return (
        F.when(is_business_summary(text), F.lit("business_summary"))
        .when(has_phrase(text, P.REORDER_INTENT_PHRASES), F.lit("reorder_decision"))
        .when(has_phrase(text, P.SALES_INTENT_PHRASES), F.lit("sales_kpi"))
        .when(mentions_customers(text), F.lit("customer_insight"))
        .when(mentions_transactions(text), F.lit("transaction_lookup"))
        .when(has_phrase(text, P.RISK_INTENT_PHRASES), F.lit("inventory_risk"))
        .when(has_word(text, P.PRODUCT_INTENT_WORDS), F.lit("product_lookup"))
        .when(asks_for_reasoning(text), F.lit("reasoning"))
        .otherwise(F.lit("general"))
    )


def needs_customers(kind: Column, text: Column) -> Column:
    return (kind == "customer_insight") | mentions_customers(text)


def needs_transactions(kind: Column, text: Column) -> Column:
    return kind.isin("transaction_lookup", "reasoning") | mentions_transactions(text)


def needs_product_focus(kind: Column) -> Column:
    return kind.isin("product_lookup", "inventory_risk", "reorder_decision", "reasoning")


def prefers_operator_answer(text: Column) -> Column:
    return has_word(text, P.OPERATOR_WORDS) | has_phrase(text, P.OPERATOR_PHRASES)


def looks_like_refusal(answer: Column) -> Column:
    return has_phrase(answer, P.REFUSAL_SIGNALS)


def analytics_used(text: Column, answer: Column, by_operator: Column) -> Column:
    return (
        F.when(by_operator, F.lit(True))
        .when(has_word(text, P.ANALYTICS_WORDS), F.lit(True))
        .when(has_word(text, P.INVENTORY_ONLY_WORDS), F.lit(False))
        .otherwise(has_phrase(answer, P.ANALYTICS_SIGNALS))
    )


def needs_strong_route(kind: Column, text: Column, confidence: Column) -> Column:
    return (
        (kind == "reasoning") | asks_for_reasoning(text) | (word_count(text) >= 18)
        | ((kind == "product_lookup") & (confidence < 0.45))
    )


def clean_answer(answer: Column) -> Column:
    """Without markers, repeated blanks and freshness notices."""
    bare = F.regexp_replace(F.regexp_replace(answer, r"\*\*", ""), "__", "")
    text = F.trim(F.regexp_replace(bare, r"\s+", " "))
    for notice in P.FRESHNESS_NOTICES:
        text = F.regexp_replace(text, "(?i)" + notice, "")
    return F.trim(text)


def embedding_text(product_id: Column, name: Column, category: Column, price: Column, quantity: Column, status: Column,
                   expiry_status: Column) -> Column:
    """The parts that are given, joined by " | "."""
    given = lambda c: F.nullif(F.trim(c.cast("string")), F.lit(""))
    labelled = lambda label, c: F.when(given(c).isNotNull(), F.concat(F.lit(label + ": "), given(c)))
    return F.concat_ws(
        " | ", given(name), given(category), labelled("product_id", product_id), labelled("price_in_inr", price),
        labelled("quantity_on_hand", quantity), labelled("status", status), labelled("expiry_status", expiry_status),
    )


def float_text(amount: Column) -> Column:
    """A two-decimal amount the way a float is printed: 12.00 as 12.0, 12.50 as 12.5."""
    return F.regexp_replace(amount.cast("decimal(18,2)").cast("string"), "0$", "")


def whole_text(amount: Column) -> Column:
    return F.round(amount.cast("decimal(18,2)"), 0).cast("decimal(18,0)").cast("string")
