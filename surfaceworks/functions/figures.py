"""Column expressions for token figures, prices, formats and permalinks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import AUTH, CODE_TOKENS, K_RANGE, STUB_TOKENS, TIMEOUT, UNREACHABLE, WINDOW_TOKENS

MODES = ("naive", "tool_search", "code_mode")
MODELS = ("openai_o200k", "claude", "gemini")


#: What modes and models are called.
MODE_LABELS = {"naive": "Naive full load", "tool_search": "Tool Search", "code_mode": "Code Mode"}
MODEL_LABELS = {"openai_o200k": "OpenAI o200k", "claude": "Claude", "gemini": "Gemini"}


def code_tokens(total: Column) -> Column:
    return F.when((total > 0) & (total < CODE_TOKENS), total).otherwise(F.lit(CODE_TOKENS).cast("long"))


def mean_tokens(total: Column, n: Column) -> Column:
    """Truncated mean; 0 of none."""
    return F.when(n > 0, F.floor(total / n)).otherwise(F.lit(0)).cast("long")


def search_tokens(mean: Column, k: Column | int) -> Column:
    """Stub and k tools; null of a null mean."""
    k = F.lit(k) if isinstance(k, int) else k
    return F.lit(STUB_TOKENS) + F.greatest(k, F.lit(0)) * mean


def modes(total: Column, n: Column) -> Column:
    """naive, tool_search and code_mode as one struct; null of a null total."""
    mean = mean_tokens(total, n)
    return F.when(
        total.isNotNull(),
        F.struct(
            F.struct(total.alias("tokens"), F.lit("measured").alias("kind")).alias("naive"),
            F.struct(F.lit(STUB_TOKENS).alias("stub_tokens"), mean.alias("per_tool_avg"), F.array(*map(F.lit, K_RANGE)).alias("k_range"), F.lit("modeled").alias("kind")).alias("tool_search"),
            F.struct(code_tokens(total).alias("tokens_estimate"), F.lit("modeled").alias("kind")).alias("code_mode"),
        ),
    )


def kind_of(mode: Column) -> Column:
    return F.when(mode == "naive", "measured").otherwise("modeled")


def cold_dollars(tokens: Column, price: Column, write: Column) -> Column:
    return tokens * (price / F.lit(1e6)) * write


def read_dollars(tokens: Column, price: Column, read: Column) -> Column:
    return tokens * (price / F.lit(1e6)) * read


def cacheable(tokens: Column, least: Column) -> Column:
    return least.isNull() | (tokens >= least)


def window_share(tokens: Column) -> Column:
    return tokens / F.lit(float(WINDOW_TOKENS)) * F.lit(100.0)


def gauge(tokens: Column) -> Column:
    """struct<filled, overloaded> of the window that a total takes: filled from 0 to 1."""
    share = tokens / F.lit(float(WINDOW_TOKENS))
    return F.struct(F.when(share.isNotNull(), F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))).alias("filled"), (share > 1).alias("overloaded"))


def labelled(c: Column, labels: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for key, label in labels.items():
        out = F.when(c == key, label).otherwise(out)
    return out


def percent_text(c: Column) -> Column:
    return F.when(c.isNull(), "n/a").otherwise(F.format_string("%.1f%%", c))


def fraction_text(c: Column) -> Column:
    return F.when(c.isNull(), "n/a").otherwise(F.format_string("%.2f", c))


def js_round(c: Column) -> Column:
    return F.floor(c + F.lit(0.5))


def tokens_text(c: Column) -> Column:
    return F.when(c.isNull(), "n/a").otherwise(F.format_number(c, 0))


def dollars_text(c: Column) -> Column:
    money = F.when(F.abs(c) < 0.01, F.format_string("$%.4f", c)).when(F.abs(c) < 1, F.format_string("$%.3f", c)).otherwise(F.format_string("$%.2f", c))
    return F.when(c.isNull(), "n/a").otherwise(money)


def failure_class(error: Column, kind: Column | None = None) -> Column:
    """Status of an error text; ``kind`` is the typed error, if known: auth, deadline, cancel, protocol, rpc."""
    low = F.lower(error)
    has = lambda parts: F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(low, p))
    kind = F.lit(None).cast("string") if kind is None else kind
    return (
        F.when(error.isNull(), "ok").when(kind == "auth", "auth").when(kind == "deadline", "timeout").when(kind == "cancel", "aborted").when(kind == "protocol", "protocol_error")
        .when((kind == "rpc") & has(AUTH), "auth").when(kind == "rpc", "protocol_error").when(has(UNREACHABLE), "unreachable").when(has(TIMEOUT), "timeout").when(has(AUTH), "auth")
        .otherwise("protocol_error")
    )


def trial_class(success: Column, client_error: Column, calls: Column, refused: Column) -> Column:
    return (
        F.when(success & (calls > 0), "tool_use_success").when(success, "answered_without_tools").when(client_error, "client_error").when(calls > 0, "tool_use_failed")
        .when(refused, "declined").otherwise("failed_no_tool_use")
    )


def permalink(servers: Column, mode: Column, model: Column) -> Column:
    return F.concat(F.lit("?servers="), F.url_encode(F.array_join(servers, ",")), F.lit("&mode="), F.url_encode(mode), F.lit("&model="), F.url_encode(model))


def from_permalink(url: Column) -> Column:
    """struct<servers, mode, model>: unknown modes and models become the first of their list."""
    q = lambda k: F.parse_url(url, F.lit("QUERY"), F.lit(k))
    servers = F.filter(F.split(F.coalesce(F.url_decode(q("servers")), F.lit("")), ","), lambda x: x != "")
    return F.struct(
        servers.alias("servers"), F.when(q("mode").isin(*MODES), q("mode")).otherwise(MODES[0]).alias("mode"), F.when(q("model").isin(*MODELS), q("model")).otherwise(MODELS[0]).alias("model")
    )


def epoch_ns(stamp: Column) -> Column:
    """Nanoseconds of an RFC 3339 stamp, which timestamps can't hold; null of what is none."""
    whole = F.unix_seconds(F.try_to_timestamp(F.regexp_replace(stamp, r"\.[0-9]+", "")))
    part = F.rpad(F.substring(F.regexp_extract(stamp, r"\.([0-9]+)", 1), 1, 9), 9, "0")
    return whole * F.lit(1_000_000_000) + F.when(F.contains(stamp, F.lit(".")), part.cast("long")).otherwise(0)
