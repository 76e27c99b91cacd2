"""Comparison-side text rules: the fixed patterns as SQL for an engine without lookahead.

The SQL engine's ``\\b`` is ASCII only, so word borders are written out, and a negative
lookahead becomes "blank out the longer form, then search".
"""

from __future__ import annotations

import re

from ..functions import fixed

_WORD = "0-9A-Za-z_가-힣"
_BEGIN = f"(?:^|[^{_WORD}])"
_END = f"(?:$|[^{_WORD}])"
_AHEAD = re.compile(r"^(.*)\(\?!(.*)\)$")


def borders(pattern: str) -> str:
    """``\\b`` written out: a start border before a word or group, else an end border."""
    out, i = [], 0
    while i < len(pattern):
        if pattern.startswith(r"\b", i):
            after = pattern[i + 2:i + 3]
            opens = after == "(" or re.match(r"[A-Za-z0-9\[]", after or "")
            out.append(_BEGIN if opens else _END)
            i += 2
        elif pattern[i] == "\\":
            out.append(pattern[i:i + 2])
            i += 2
        else:
            out.append(pattern[i])
            i += 1
    return "".join(out)


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def matches(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {quote(borders(pattern))})"


def name_case(column: str) -> str:
    """CASE expression for the canonical product of a text column."""
    clean = f"trim(regexp_replace({column}, '\\s+', ' ', 'g'))"
    arms = [f"WHEN lower({clean}) = {quote(k)} THEN {quote(v)}"
            for k, v in fixed.BARE_ALIASES.items()]
    for pattern, name in fixed.NAME_PATTERNS:
        ahead = _AHEAD.match(pattern)
        text = clean
        if ahead:
            pattern, longer = ahead.groups()
            stem = pattern.removesuffix(r"\b")
            text = (f"regexp_replace({clean}, {quote(borders(stem + longer))}, ' ', 'g')")
        arms.append(f"WHEN {matches(text, pattern)} THEN {quote(name)}")
    return "CASE " + " ".join(arms) + " END"


def identity(name: str) -> str:
    buckets = ", ".join(quote(b) for b in fixed.DISCOVERY_ONLY)
    return f"({name} IS NOT NULL AND {name} NOT IN ({buckets}))"


def joined(title: str, description: str) -> str:
    return f"({title} || chr(10) || {description})"


def condition_case(title: str, description: str) -> str:
    text = f"trim(regexp_replace(lower({joined(title, description)}), '\\s+', ' ', 'g'))"
    for pattern in fixed.CONDITION_RULES["normal_overrides"]:
        text = f"regexp_replace({text}, {quote(borders(pattern))}, ' ', 'g')"
    arms = []
    for group in ("broken", "risky", "unknown"):
        tests = " OR ".join(matches("folded", p) for p in fixed.CONDITION_RULES[group])
        arms.append(f"WHEN {tests} THEN '{group}'")
    return text, ("CASE " + " ".join(arms)
                  + f" WHEN trim({description}) = '' THEN 'unknown' ELSE 'normal' END")


def scope_case(title: str, description: str) -> str:
    text = joined(title, description)
    hits = {k: matches(text, p) for k, p in fixed.SPEC_SIGNALS.items()}
    total = " + ".join(f"CAST({h} AS INT)" for h in hits.values())
    platform = " OR ".join(hits[k] for k in fixed.PLATFORM_SIGNALS)
    system = " AND ".join(hits[k] for k in fixed.SYSTEM_SIGNALS)
    label = quote(fixed.COMPONENT_LABEL)
    return f"""CASE WHEN {matches(title, fixed.TITLE_NOT_FOR_SALE)} THEN 'unknown'
 WHEN {matches(text, fixed.LAPTOP_TERMS)} OR {matches(text, fixed.LAPTOP_MODEL)} THEN 'unknown'
 WHEN {matches(title, fixed.TITLE_BOX)} AND NOT {matches(title, fixed.TITLE_FULL_BOX)}
   THEN 'accessory'
 WHEN {matches(title, fixed.TITLE_MULTI_PARTS)} THEN 'bundle'
 WHEN {matches(title, fixed.TITLE_COMPLETE_PC)} OR {matches(text, fixed.COMPLETE_PC)}
   THEN 'complete_pc'
 WHEN len(list_distinct(list_transform(regexp_extract_all({text}, {label}, 1),
   lambda x: lower(x)))) >= 2 THEN 'complete_pc'
 WHEN (({total}) >= 3 AND ({platform})) OR ({system}) THEN 'complete_pc'
 WHEN {matches(text, fixed.BUNDLE)} THEN 'bundle' END"""


def old_scope_case(title: str, description: str) -> str:
    text = joined(title, description)
    return f"""CASE WHEN {matches(text, fixed.OLD_BOX_ONLY)} THEN 'accessory'
 WHEN {matches(text, fixed.OLD_COMPLETE_PC)} THEN 'complete_pc'
 WHEN {matches(text, fixed.OLD_BUNDLE)} THEN 'bundle' ELSE 'standalone' END"""


def part_test(text: str) -> str:
    return matches(text, fixed.PART_TERMS)
