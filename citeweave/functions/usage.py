"""Client buckets, token and cost arithmetic, money and date formats."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import let

# Outcomes that wrote (or are writing) an answer and so use up a quota.
ANSWER_OUTCOMES = ("generated", "error", "pending")
CHARS_PER_TOKEN = 4
FALLBACK_MAX_TOKENS = 2048


@dataclass(frozen=True)
class Pricing:
    """USD per million tokens and the output cap of one answer."""

    input_per_mtok: float = 0.0
    output_per_mtok: float = 0.0
    max_tokens: int | None = None

    @property
    def max_output(self) -> int:
        return self.max_tokens or FALLBACK_MAX_TOKENS


@dataclass(frozen=True)
class Quota:
    """Limits of the gate: global daily budget, answers per day and per sliding window."""

    daily_budget_usd: float = 1.0
    daily_answers: int = 20
    window_answers: int = 5
    window_minutes: int = 10


_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_HEX = "[0-9a-f]{1,4}"


def _groups(part: Column) -> Column:
    return F.when(part == "", F.array().cast("array<string>")).otherwise(F.split(part, ":"))


def _network(low: Column) -> Column:
    """The /64 of an IPv6 address, null when the text is none."""
    # A trailing dotted quad counts as two groups.
    plain = F.regexp_replace(low, rf"{_IPV4}$", "0:0")
    halves = let(F.split(plain, "::", -1), lambda h: F.struct(_groups(F.get(h, F.lit(0))).alias("left"), _groups(F.coalesce(F.get(h, F.lit(1)), F.lit(""))).alias("right"), F.size(h).alias("n")))

    def full(h: Column) -> Column:
        missing = 8 - F.size(h.left) - F.size(h.right)
        return F.when((h.n == 2) & (missing >= 1), F.concat(h.left, F.array_repeat(F.lit("0"), F.greatest(F.lit(0), missing)), h.right)).when(h.n == 1, h.left)

    def shown(groups: Column) -> Column:
        # Four groups without leading zeros. The zero host half is longer than any other
        # zero run, so "::" always stands for it and the zero groups before it.
        net = F.array_join(F.transform(F.slice(groups, 1, 4), lambda g: F.lower(F.conv(g, 16, 16))), ":")
        ok = (F.size(groups) == 8) & F.forall(groups, lambda g: g.rlike(rf"^{_HEX}$"))
        return F.when(ok, F.concat(F.regexp_replace(net, r"(?:^|:)0(?::0)*$", ""), F.lit("::/64")))

    return let(let(halves, full), shown)


def _mapped(low: Column) -> Column:
    """The IPv4 address inside an IPv4-mapped one, null when the text is none."""
    prefix = r"^(?:(?:0{1,4}:){5}|::(?:0{1,4}:){0,4})ffff:"
    dotted = F.regexp_extract(low, rf"{prefix}({_IPV4})$", 1)
    pair = F.regexp_extract(low, rf"{prefix}({_HEX}:{_HEX})$", 1)
    both = F.concat(F.lpad(F.substring_index(pair, ":", 1), 4, "0"), F.lpad(F.substring_index(pair, ":", -1), 4, "0"))
    quad = F.concat_ws(".", *[F.conv(F.substring(both, i, 2), 16, 10) for i in (1, 3, 5, 7)])
    return F.when(dotted != "", dotted).when(pair != "", quad)


def ip_bucket(host: Column) -> Column:
    """IPv4 as is, an IPv4-mapped address unwrapped, IPv6 cut to its /64; anything else unchanged."""
    six = lambda low: F.coalesce(_mapped(low), _network(low), host)
    return F.when(host.contains(":"), let(F.lower(host), six)).otherwise(host)


def day_start(ts: Column) -> Column:
    return F.date_trunc("DAY", ts)


def cost_usd(input_tokens: Column, output_tokens: Column, thinking_tokens: Column, p: Pricing) -> Column:
    """Cost of an answer; thinking is billed as output."""
    return (input_tokens * F.lit(p.input_per_mtok) + (output_tokens + thinking_tokens) * F.lit(p.output_per_mtok)) / F.lit(1_000_000.0)


def estimate_tokens(chars: Column) -> Column:
    return F.ceil(chars / CHARS_PER_TOKEN)


def worst_case_cost(prompt_chars: Column, p: Pricing) -> Column:
    return cost_usd(estimate_tokens(prompt_chars), F.lit(p.max_output), F.lit(0), p)


def repaired_tokens(received: Column, finish_reason: Column, input_tokens: Column, output_tokens: Column, thinking_tokens: Column,
                    prompt_chars: Column, text: Column, p: Pricing) -> Column:
    """struct of token counts: a stream that broke off estimates what it did not report."""
    broke = received & finish_reason.isNull()
    guess = lambda reported, estimate: F.coalesce(reported, F.when(broke, estimate).otherwise(0)).cast("bigint")
    return F.struct(
        guess(input_tokens, estimate_tokens(prompt_chars)).alias("input_tokens"),
        guess(output_tokens, estimate_tokens(F.length(text))).alias("output_tokens"),
        guess(thinking_tokens, F.lit(p.max_output)).alias("thinking_tokens"),
    )


def generator_label(provider: Column, model: Column, thinking_level: Column) -> Column:
    """Provider-qualified model name, plus the thinking level when one is set."""
    return F.concat(provider, F.lit(":"), model, F.when(F.coalesce(thinking_level, F.lit("")) != "", F.concat(F.lit(":think="), thinking_level)).otherwise(""))


def answer_model(label: Column) -> Column:
    """The model part of a generator label, as history and ledger rows record it."""
    return F.regexp_replace(F.regexp_replace(label, r"^[^:]*:", ""), r":think=.*$", "")


def usd(amount: Column) -> Column:
    return F.concat(F.when(amount < 0, "-$").otherwise("$"), F.format_number(F.abs(amount), 2))


def usd_precise(amount: Column) -> Column:
    """Five significant figures, never fewer than two decimals, no exponent."""
    size = F.abs(amount)
    digits = F.when(size == 0, 4).otherwise(F.greatest(F.lit(2), 4 - F.floor(F.log10(size)))).cast("int")
    shown = F.coalesce(F.when(size == 0, "0.00"), F.regexp_replace(
        _fixed(size, digits), r"^(.*\.\d\d\d*?)0*$", "$1"))
    return F.concat(F.when(amount < 0, "-$").otherwise("$"), shown)


def _fixed(value: Column, digits: Column) -> Column:
    """A number with so many decimals, grouped by thousands; decimals are shifted into a whole number, so any count will do."""
    shifted = F.when(digits <= 18, F.format_string("%.0f", F.round(value * F.pow(F.lit(10.0), digits), 0))).otherwise(F.format_string("%.0f", F.round(value * F.pow(F.lit(10.0), F.lit(18)) * F.pow(F.lit(10.0), digits - 18), 0)))
    padded = F.lpad(shifted, F.greatest(F.length(shifted), digits + 1), "0")
    whole = F.substring(padded, F.lit(1), F.length(padded) - digits)
    return F.concat(F.format_number(whole.cast("decimal(38,0)"), 0), F.lit("."), F.substring(padded, F.length(padded) - digits + 1, digits))


def short_date(ts: Column) -> Column:
    return F.date_format(ts, "MMM d")


def calendar_date(day: Column) -> Column:
    return F.date_format(F.to_date(day), "MMM d, yyyy")


def history_time(ts: Column, zone: str = "UTC") -> Column:
    local = F.from_utc_timestamp(ts, zone)
    return F.concat(F.date_format(local, "MMM d"), F.lit(" · "), F.date_format(local, "HH:mm"))


def reset_time(now: Column, zone: str = "UTC") -> Column:
    """Next UTC midnight, shown in a zone."""
    return F.date_format(F.from_utc_timestamp(F.date_trunc("DAY", now) + F.expr("INTERVAL 1 DAY"), zone), "h:mm a")


def chart_max(day_max: Column, budget: float) -> Column:
    """Top of the spend chart: the budget, or higher when a day went over it; never 0."""
    top = F.greatest(F.coalesce(day_max, F.lit(0.0)), F.lit(float(budget)), F.lit(0.0))
    return F.when(top == 0, 1.0).otherwise(top)


def bar_height(value: Column, top: Column, height: int) -> Column:
    return F.floor(value / top * height + 0.5).cast("bigint")


def format_metric(value: Column, kind: Column) -> Column:
    """``-`` for null; ``pct`` one decimal with a sign, ``int`` rounded, ``fN`` N decimals.
    Digits past the ninth are noise of the order of summation and are dropped first."""
    value = F.round(value, 9)
    return (
        F.when(value.isNull(), "-")
        .when(kind == "pct", F.concat(F.format_string("%.1f", F.bround(F.round(value * 100, 9), 1)), F.lit("%")))
        .when(kind == "int", F.format_string("%d", F.bround(value, 0).cast("bigint")))
        .when(kind == "f1", F.format_string("%.1f", F.bround(value, 1)))
        .when(kind == "f2", F.format_string("%.2f", F.bround(value, 2)))
        .otherwise(F.format_string("%.3f", F.bround(value, 3)))
    )


def metric_arrow(old: Column, new: Column, direction: Column, kind: Column) -> Column:
    """Up or down mark of a metric, empty when nothing visible changed."""
    same = format_metric(old, kind) == format_metric(new, kind)
    return (
        F.when(old.isNull() | new.isNull() | (direction == 0) | same, "")
        .when((new - old) * direction > 0, "▲").otherwise("▼")
    )
