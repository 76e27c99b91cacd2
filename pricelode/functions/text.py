"""Listing text: product names, part terms, price text, condition and scope.

Patterns run natively (``rlike``).  ``(?Ud)`` gives word, digit and space classes their
Unicode meaning and makes ``\\n`` the only line end; ``(?-u)`` keeps case-insensitive letters
ASCII, which the patterns are.  Word borders next to a word character are written as
look-arounds, which the JVM matches far faster than a Unicode ``\\b``.  The one Python step
is Unicode normalisation of non-ASCII condition text, done on Arrow batches.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from re import _constants as sre
from re import _parser as sre_parser
from collections.abc import Callable, Iterable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed

_DIALECT = "(?Ud)(?-u)"
_STARTS = re.compile(r"(?:\(\?:|\((?!\?))*[0-9A-Za-z가-힣\[]")
_ENDS = re.compile(r"(?<!\\)[0-9A-Za-z가-힣)\]*?+}]$")
# Fixed value: full-width digits read as ASCII digits in price text.
_WIDE_DIGITS = "０１２３４５６７８９"


def word_borders(pattern: str) -> str:
    """``\\b`` as a look-around, where the pattern has a word character on one side of it."""
    pieces = pattern.split(r"\b")
    out = pieces[0]
    for before, after in zip(pieces, pieces[1:]):
        if _STARTS.match(after):
            out += r"(?<!\w)"
        elif _ENDS.search(before):
            out += r"(?!\w)"
        else:
            out += r"\b"
        out += after
    return out


def _better(a: frozenset[str] | None, b: frozenset[str] | None) -> frozenset[str] | None:
    """The set whose shortest text is longer, then the smaller one."""
    if a is None or b is None:
        return a if b is None else b
    return max(a, b, key=lambda x: (min(map(len, x)), -len(x)))


def _letters(op, value) -> list[str]:
    """The lower-case letters of which one element of a pattern is one, if they are few."""
    members = value if op is sre.IN else [(op, value)]
    if len(members) > 4 or any(kind is not sre.LITERAL for kind, _ in members):
        return []
    letters = {chr(code) for _, code in members}
    # Letters outside ASCII that have another case are left to the pattern.
    return sorted({x.lower() for x in letters}) if all(x.isascii() or x.lower() == x for x in letters) else []


def _needles(parsed) -> frozenset[str] | None:
    best, runs = None, [""]
    for op, value in [*parsed, (None, None)]:
        optional = op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[:2] == (0, 1) and len(value[2]) == 1
        letters = _letters(*(value[2][0] if optional else (op, value)))
        if letters and len(runs) * (len(letters) + optional) <= 8:
            longer = [run + letter for run in runs for letter in letters]
            runs = runs + longer if optional else longer
            continue
        if "" not in runs:
            best = _better(best, frozenset(runs))
        runs, inner = [""], None
        if op is sre.BRANCH:
            arms = [_needles(arm) for arm in value[1]]
            inner = None if None in arms else frozenset().union(*arms)
        elif op is sre.SUBPATTERN:
            inner = _needles(value[3])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] > 0:
            inner = _needles(value[2])
        best = _better(best, inner)
    return best


@functools.cache
def needles(pattern: str) -> frozenset[str] | None:
    """Lower-case texts of which every match of a pattern holds one, or None if there are no such.

    A byte search for them is far cheaper than the pattern, and most texts hold none.
    """
    return _needles(sre_parser.parse(pattern))


def holds_any(low: Column, pattern: str) -> Column:
    """Cheap test on lower-case text that is true wherever the pattern could match."""
    wanted = needles(pattern)
    if wanted is None or "" in wanted or max(map(len, wanted)) < 2 and len(wanted) > 2:
        return F.lit(True)
    return functools.reduce(Column.__or__, (F.contains(low, F.lit(x)) for x in _least(wanted)))


def _least(texts: Iterable[str]) -> list[str]:
    """The texts that hold none of the others."""
    texts = set(texts)
    return sorted(x for x in texts if not any(y != x and y in x for y in texts))


def found(text: Column, pattern: str, low: Column | None = None) -> Column:
    """Unicode-aware search for a fixed pattern; null text finds nothing.

    ``low`` is the text in lower case: with it the pattern runs only where it could match.
    """
    hit = text.rlike(_DIALECT + word_borders(pattern))
    return F.coalesce(hit if low is None else holds_any(low, pattern) & hit, F.lit(False))


def any_of(text: Column, patterns: Sequence[str]) -> Column:
    """Search folded text for any of several rule patterns.

    Patterns that start at a word border share one border test.  Folded text needs no case
    flag for lower-case patterns.
    """
    def fold(p: str) -> str:
        return p if re.sub(r"\\.", "", p).islower() or not re.search("[A-Z]", p) else f"(?i:{p})"

    bounded = [p for p in patterns if re.match(r"\\b[a-z(]", p) and "|" not in _outside(p)]
    free = [p for p in patterns if p not in bounded]
    arms = [f"(?:{fold(word_borders(p))})" for p in free]
    if bounded:
        arms.append(r"\b(?:" + "|".join(fold(word_borders(p[2:])) for p in bounded) + ")")
    hit = F.lit(False)
    if arms:
        gate = functools.reduce(Column.__or__, (holds_any(text, p) for p in patterns))
        hit = F.coalesce(gate & text.rlike(_DIALECT + word_borders("|".join(arms))), F.lit(False))
    return hit


def _outside(pattern: str) -> str:
    """The part of a pattern outside all groups and classes."""
    depth, out = 0, []
    for c in re.sub(r"\\.", "", pattern):
        depth += c in "(["
        if not depth:
            out.append(c)
        depth -= c in ")]"
    return "".join(out)


def replaced(text: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(text, F.lit(_DIALECT + pattern), F.lit(by))


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is evaluated once, however often ``then`` reads it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def squeezed(text: Column) -> Column:
    return F.trim(replaced(text, r"\s+", " "))


def _aliases() -> Column:
    return F.create_map(*[F.lit(x) for pair in fixed.BARE_ALIASES.items() for x in pair])


def bare_alias(text: Column) -> Column:
    """Product named by a bare model token; the token must be the whole text."""
    return F.element_at(_aliases(), F.lower(squeezed(text)))


def product_name(text: Column) -> Column:
    """Canonical product of a text: bare alias, else the first matching pattern.

    Most texts name no product and cost one scan for any model token.  The rest test the
    patterns in runs, so only the runs whose tokens occur are tried.  Patterns allow any
    white space, so only the alias needs the squeezed text.
    """
    def named(both: Column) -> Column:
        text, low = both["text"], both["low"]
        alias = functools.reduce(Column.__or__, (F.contains(low, F.lit(x)) for x in _least(fixed.BARE_ALIASES)))
        arms, start = [F.when(alias, bare_alias(text))], 0
        for tokens, count in fixed.NAME_RUNS:
            run = fixed.NAME_PATTERNS[start:start + count]
            start += count
            chain = F
            for pattern, name in run:
                chain = chain.when(found(text, pattern, low), F.lit(name))
            arms.append(F.when(text.rlike(tokens), chain))
        return F.coalesce(*arms)

    return F.when(text.rlike(fixed.NAME_GATE), once(F.struct(text.alias("text"), F.lower(text).alias("low")), named))


def is_pricing_identity(name: Column) -> Column:
    return name.isNotNull() & ~F.coalesce(name.isin(*fixed.DISCOVERY_ONLY), F.lit(False))


def exact_model(name: Column, title_name: Column, description_name: Column) -> Column:
    """Whether a canonical name is evidenced by already normalised text names."""
    return (F.coalesce(title_name == name, F.lit(False))
            | F.coalesce(description_name == name, F.lit(False)))


def mentions_part(text: Column) -> Column:
    return found(text, fixed.PART_TERMS)


def price_from_text(text: Column) -> Column:
    """All digits of a display price as one number; free or negotiable gives null."""
    digits = F.translate(replaced(text, r"\D", ""), _WIDE_DIGITS, "0123456789")
    return F.when(~found(text, fixed.NO_PRICE), F.nullif(digits, F.lit("")).try_cast("bigint"))


def listing_status(label: Column) -> Column:
    upper = F.upper(F.coalesce(label, F.lit("")))
    chain = F.when(upper.isin(*fixed.STATUS_LABELS["active"]), "active")
    for status in ("reserved", "sold"):
        chain = chain.when(upper.isin(*fixed.STATUS_LABELS[status]), status)
    return chain.otherwise("unavailable")


# --- condition -------------------------------------------------------------

@F.pandas_udf(T.StringType())
def _nfkc_folded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def folded(text: Column) -> Column:
    """NFKC + case folding + whitespace collapse; only non-ASCII text goes to Python."""
    wide = text.rlike(r"[^\x00-\x7F]")
    normal = F.coalesce(_nfkc_folded(F.when(wide, text)), F.lower(text))
    return squeezed(normal)


def check_rules(rules: Mapping[str, Sequence[str]]) -> dict[str, list[str]]:
    """A condition rule table with all four groups of valid patterns, or ValueError."""
    missing = set(fixed.CONDITION_RULES) - set(rules)
    if missing:
        raise ValueError(f"condition rules lack {sorted(missing)}")
    out = {}
    for group in fixed.CONDITION_RULES:
        patterns = rules[group]
        if isinstance(patterns, str) or not isinstance(patterns, Sequence):
            raise ValueError(f"condition rule group {group!r} must be a list of patterns")
        for pattern in patterns:
            if not isinstance(pattern, str):
                raise ValueError(f"condition rule group {group!r} holds a non-string")
            try:
                re.compile(pattern)
            except re.error as exc:
                raise ValueError(f"invalid condition rule in {group!r}: {exc}") from exc
        out[group] = list(patterns)
    return out


def joined_text(title: Column, description: Column) -> Column:
    return F.concat(title, F.lit("\n"), F.coalesce(description, F.lit("")))


def condition_status(title: Column, description: Column,
                     rules: Mapping[str, Sequence[str]] | None = None,
                     inspected: Column | bool = True) -> Column:
    """broken / risky / unknown / normal; missing description is unknown.

    Phrases such as "no defect" are blanked first, then each group is one alternation.
    """
    return condition_from_folded(folded(joined_text(title, description)), description,
                                 rules, inspected)


def condition_from_folded(text: Column, description: Column,
                          rules: Mapping[str, Sequence[str]] | None = None,
                          inspected: Column | bool = True) -> Column:
    table = fixed.CONDITION_RULES if rules is None else check_rules(rules)
    overrides = table["normal_overrides"]

    def blanked(whole: Column) -> Column:
        out = whole
        for pattern in overrides:
            out = replaced(out, f"(?i){pattern}" if re.search("[A-Z]", pattern) else pattern, " ")
        gate = functools.reduce(Column.__or__, (holds_any(whole, p) for p in overrides))
        return F.when(gate, out).otherwise(whole)

    if overrides:
        text = once(text, blanked)
    described = F.coalesce(description.rlike(_DIALECT + r"\S"), F.lit(False))
    seen = inspected if isinstance(inspected, Column) else F.lit(inspected)

    def group(cleaned: Column) -> Column:
        chain = F
        for name in ("broken", "risky", "unknown"):
            chain = chain.when(any_of(cleaned, table[name]), F.lit(name))
        return chain

    return F.coalesce(once(text, group), F.when(seen & described, "normal").otherwise("unknown"))


# --- scope -----------------------------------------------------------------

def component_labels(text: Column) -> Column:
    """Number of distinct component labels ("CPU:", "RAM ..", ...) in a text."""
    labels = F.regexp_extract_all(text, F.lit(_DIALECT + fixed.COMPONENT_LABEL), F.lit(1))
    return F.size(F.array_distinct(F.transform(labels, F.lower)))


def has_spec_inventory(text: Column, low: Column | None = None) -> Column:
    """Whether a text lists the parts of a whole computer; ``low`` is the text in lower case."""
    if low is None:
        both = F.struct(text.alias("text"), F.lower(text).alias("low"))
        return once(both, lambda b: has_spec_inventory(b["text"], b["low"]))
    hits = {name: found(text, pattern, low) for name, pattern in fixed.SPEC_SIGNALS.items()}
    # Boards have no text to look for: their pattern runs where it could decide.
    others = sum((hit.cast("int") for name, hit in hits.items() if name != "board"), F.lit(0))

    def judged(count: Column) -> Column:
        platform = F.lit(False)
        for name in fixed.PLATFORM_SIGNALS:
            if name != "board":
                platform = platform | hits[name]
        system = F.lit(True)
        for name in fixed.SYSTEM_SIGNALS:
            system = system & hits[name]
        return F.when(count < 2, F.lit(False)).otherwise(((count >= 3) & platform) | system | hits["board"])

    return once(others, judged)


def listing_scope(title: Column, description: Column, accessory_text: bool = False) -> Column:
    """Unambiguous non-standalone scope, or null.

    ``accessory_text`` turns on the intended accessory wording rule, which the
    published rule set never triggers.
    """
    text = joined_text(title, description)

    def ruled(both: Column) -> Column:
        text, low = both["text"], both["low"]
        # The title is part of the text: what the text doesn't hold, the title doesn't.
        chain = (
            F.when(found(title, fixed.TITLE_NOT_FOR_SALE, low), "unknown")
            .when(found(text, fixed.LAPTOP_TERMS, low) | found(text, fixed.LAPTOP_MODEL, low), "unknown")
            .when(found(title, fixed.TITLE_BOX, low) & ~found(title, fixed.TITLE_FULL_BOX), "accessory")
            .when(found(title, fixed.TITLE_MULTI_PARTS, low), "bundle")
        )
        if accessory_text:
            chain = chain.when(found(text, fixed.ACCESSORY_TEXT, low), "accessory")
        return (
            chain
            .when(found(title, fixed.TITLE_COMPLETE_PC, low) | found(text, fixed.COMPLETE_PC, low),
                  "complete_pc")
            .when(holds_any(low, fixed.COMPONENT_LABEL) & (component_labels(text) >= 2), "complete_pc")
            .when(has_spec_inventory(text, low), "complete_pc")
            .when(found(text, fixed.BUNDLE, low), "bundle")
        )

    return F.when(text.isNotNull(), once(F.struct(text.alias("text"), F.lower(text).alias("low")), ruled))


def historical_scope(title: Column, description: Column) -> Column:
    text = joined_text(title, description)
    return (F.when(found(text, fixed.OLD_BOX_ONLY), "accessory")
            .when(found(text, fixed.OLD_COMPLETE_PC), "complete_pc")
            .when(found(text, fixed.OLD_BUNDLE), "bundle")
            .otherwise("standalone"))


def rejection_reason(status: Column, condition: Column, scope: Column, text: Column,
                     title_name: Column, description_name: Column) -> Column:
    """First deterministic reason to reject a listing before any verdict is sought."""
    return (
        F.when(status != "active", F.concat(F.lit(fixed.RULE_REASONS["status"]), status))
        .when(condition != "normal",
              F.concat(F.lit(fixed.RULE_REASONS["condition"]), condition))
        .when(scope.isNotNull(), F.concat(F.lit(fixed.RULE_REASONS["scope"]), scope))
        .when(~mentions_part(text), F.lit(fixed.RULE_REASONS["part"]))
        .when(title_name != description_name,
              F.lit(fixed.RULE_REASONS["mismatch"]))
    )


def standalone_name(reason: Column, title_name: Column, description_name: Column) -> Column:
    """Product that the title names and nothing contradicts, else null."""
    return F.when(
        reason.isNull() & (description_name.isNull() | (description_name == title_name)),
        title_name)


def name_mismatch(name: Column, title_name: Column, description_name: Column) -> Column:
    return ~is_pricing_identity(name) | ~exact_model(name, title_name, description_name)


# --- links -----------------------------------------------------------------

def product_link(canonical_url: Column, product_id: Column, marketplace: Column,
                 expected_marketplace: str, template: str = fixed.PRODUCT_LINK) -> Column:
    """Canonical link of a listing; raises for other marketplaces or a missing id."""
    made = F.when(product_id.isNotNull(), F.format_string(template, product_id))
    link = F.coalesce(F.nullif(canonical_url, F.lit("")), made,
                      F.raise_error(F.lit("a product link needs a product_id")).cast("string"))
    return F.when(
        F.coalesce(marketplace == expected_marketplace, F.lit(False)), link,
    ).otherwise(F.raise_error(F.lit("listing is from another marketplace")).cast("string"))


def canonical_page_url(base: Column, href: Column) -> Column:
    """Link resolved against its page, query part dropped."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    bare = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/]*(?:/.*/|/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    full = (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("?") | (href == "") | href.startswith("#"), F.concat(bare, href))
        .otherwise(F.concat(folder, href))
    )
    return F.substring_index(full, "?", 1)
