"""Spans: find them, join overlaps, merge token tags, mask and list them.

Offsets count code points, as Spark's ``length`` and ``substring`` do.
Pieces are cut out of blocks of the text, so a cut walks one block and not the
text from its start.  Nothing is decoded: all bytes stay as they are.
"""

from __future__ import annotations

from collections.abc import Sequence
from string import digits

from veilwork import schemas
from veilwork.functions import rules
from veilwork.functions.rules import PiiRule
from veilwork.functions.sqltext import blocks, cut_out, grouped, holds, let, lit, running

# Noncharacters, which text for interchange does not hold.  If a text has MARK
# all the same, matching sees SPARE in its place: same length, same offsets.
MARK = "﷐"
SPARE = "﷑"

NO_SPANS = f"CAST(array() AS {schemas.SPANS})"


def each_match(text: str, pattern: str, found: str) -> str:
    """Array of ``found`` for each match ``p`` of a pattern; it begins at ``at[i]``.

    One pass of the pattern marks the matches, and a split at the marks makes
    every second piece a match.
    """
    marked = f"regexp_replace({text}, {lit(pattern)}, '{MARK}$0{MARK}')"
    begins = f"filter({running('ps', '0', 'q.l + length(x)')}, (b, i) -> i % 2 = 1)"
    taken = let("at", begins, f"transform(filter(ps, (p, i) -> i % 2 = 1), (p, i) -> {found})")
    # a text without a match comes back as it was
    return let("m", marked, f"IF(m != {text}, {let('ps', f"split(m, '{MARK}', -1)", taken)}, NULL)")


def rule_spans(text: str, rule: PiiRule, prio: int) -> str:
    """All matches of one rule, left to right, as an array of spans."""
    span = (
        f"named_struct('start', at[i], 'prio', {prio}, "
        f"'end', at[i] + length(p), "
        f"'label', '{rule.label}', 'score', {rule.score}D, 'word', p)"
    )
    found = f"coalesce({each_match(text, rule.regex, span)}, {NO_SPANS})"
    return f"IF({holds(text, rule.needs)}, {found}, {NO_SPANS})" if rule.needs else found


def line_spans(text: str, ranked: Sequence[tuple[PiiRule, int]]) -> str:
    """Matches of rules that need a digit or an @, and stay within a line.

    Few lines hold such a character.  One pass cuts those out; the rules look
    at nothing else, and at a line only if a joint scan says that one of them
    will match.
    """
    # an @ in the line stands for the e-mail rule, whose own scan is dear
    cheap = [r for r, _ in ranked if "@" not in r.needs]
    firsts = "@" + "".join(r.first for r in cheap)
    ahead = f"(?={rules.one_of(firsts)})" if all(r.first for r in cheap) else ""
    scan = lit(f"{ahead}(?:{'|'.join(['@', *(r.pattern for r in cheap)])})")
    found = f"concat({', '.join(rule_spans('l', r, i) for r, i in ranked)})"
    shifted = (
        f"transform({found}, x -> named_struct('start', x.start + at[i], "
        "'prio', x.prio, 'end', x.end + at[i], 'label', x.label, "
        "'score', x.score, 'word', x.word))"
    )
    in_line = let("l", "p", f"IF(rlike(l, {scan}), {shifted}, {NO_SPANS})")
    key = rules.one_of(digits + "@")
    line = rf"(?md)^[^\n{key[1:-1]}]*+{key}[^\n]*"
    lines = f"coalesce(flatten({each_match(text, line, in_line)}), {NO_SPANS})"
    return f"IF(rlike({text}, '{key}'), {lines}, {NO_SPANS})"


def raw_spans(text: str, pii_rules: Sequence[PiiRule] = rules.PII_RULES) -> str:
    """Matches of all rules; spans of different rules may overlap."""
    ranked = [(r, i + 1) for i, r in enumerate(pii_rules)]
    in_line = [(r, i) for r, i in ranked if r.in_line]
    parts = [line_spans("t", in_line)] if in_line else []
    parts += [rule_spans("t", r, i) for r, i in ranked if not r.in_line]
    clean = f"replace({text}, '{MARK}', '{SPARE}')"
    every = f"concat({', '.join(parts)})" if parts else NO_SPANS
    return f"IF({text} IS NULL, {NO_SPANS}, {let('t', clean, every)})"


def overlaps(spans: str) -> str:
    """True where a span begins before the one in front of it ends."""
    return f"exists(sequence(1, size({spans}) - 1), i -> {spans}[i].start < {spans}[i - 1].end)"


def resolve_spans(text: str, spans: str) -> str:
    """Join overlapping spans: the union is kept, the best rule names it.

    Words of joined spans, and all words of a text that holds the mark, are
    taken from the text by offset.
    """
    worded = (
        f"transform({joined_spans()}, x -> named_struct('start', x.start, 'prio', x.prio, "
        "'end', x.end, 'label', x.label, 'score', x.score, "
        f"'word', {cut_out('bl', 'x.start', 'x.end')}))"
    )
    changed = f"size(s) > 0 AND (contains({text}, '{MARK}') OR (size(s) > 1 AND {overlaps('s')}))"
    return let(
        "s", f"array_sort({spans})", f"IF({changed}, {let('bl', blocks(text), worded)}, s)"
    )


def joined_spans(word: str = "CAST(NULL AS string)") -> str:
    """Unions of the sorted spans ``s`` that overlap; ``word`` is made of a group ``g``."""
    # where a span begins behind all ends before it, a union begins
    best = "aggregate(g, g[0], (b, x) -> IF(x.prio < b.prio, x, b))"
    union = let("be", best, (
        "named_struct('start', g[0].start, 'prio', be.prio, "
        "'end', array_max(transform(g, x -> x.end)), 'label', be.label, 'score', be.score, "
        f"'word', {word})"
    ))
    ends = running("s", "-1", "greatest(q.l, x.end)")
    return let("me", ends, f"transform({grouped('s[i].start >= me[i]')}, g -> {union})")


def spans_to_entities(spans: str) -> str:
    return (
        f"transform({spans}, x -> named_struct('entity_group', x.label, "
        "'entity', CAST(NULL AS string), 'score', x.score, 'word', x.word, "
        "'start', x.start, 'end', x.end))"
    )


def detect_entities(text: str, pii_rules: Sequence[PiiRule] = rules.PII_RULES) -> str:
    """Typed spans of a text: disjoint, left to right."""
    return spans_to_entities(resolve_spans(text, raw_spans(text, pii_rules)))


def entity_type(label: str) -> str:
    """Label without its B- or I- tag."""
    return f"regexp_replace({label}, '^[BI]-', '')"


def mask_label(label: str) -> str:
    return f"upper({entity_type(label)})"


def apply_mask(text: str, entities: str) -> str:
    """Replace every span by ``[LABEL]``, from the right end to the left.

    Given spans are taken as they are.  A span that overlaps the one to its
    right therefore cuts text that has been changed already, and of spans
    with one start the first listed is put in first.  Offsets below zero
    count from the end of the text.
    """
    # sorts to: right to left, list order where starts are equal
    item = (
        "named_struct('back', -coalesce(e.start, 0), 'i', i, "
        f"'end', coalesce(e.end, length({text})), "
        f"'mask', concat('[', {mask_label('coalesce(e.entity_group, e.entity)')}, ']'))"
    )
    items = (
        f"array_sort(filter(transform({entities}, (e, i) -> "
        f"IF(coalesce(e.entity_group, '') != '' OR coalesce(e.entity, '') != '', {item}, NULL)), "
        "x -> x IS NOT NULL))"
    )
    # spans that do not touch each other are put in between the pieces around them
    tidy = (
        "forall(sequence(0, size(d) - 1), i -> d[i].back <= 0 AND d[i].end >= -d[i].back AND "
        f"IF(i = 0, d[i].end <= length({text}), d[i].end <= -d[i - 1].back))"
    )
    # d runs right to left, so the piece behind span i ends where span i-1 starts
    behind = cut_out("bl", "x.end", f"IF(i = 0, length({text}), -d[i - 1].back)")
    pieces = f"transform(d, (x, i) -> concat(x.mask, {behind}))"
    linear = let("bl", blocks(text), (
        f"concat({cut_out('bl', '0', '-d[size(d) - 1].back')}, array_join(reverse({pieces}), ''))"
    ))
    stepwise = (
        f"aggregate(d, CAST({text} AS string), (m, x) -> concat("
        "substring(m, 1, IF(x.back > 0, greatest(length(m) - x.back, 0), -x.back)), x.mask, "
        "substring(m, IF(x.end < 0, greatest(length(m) + x.end, 0), x.end) + 1)))"
    )
    return (
        f"IF({text} IS NULL OR coalesce(size({entities}), 0) <= 0, {text}, "
        + let("d", items, f"IF(size(d) = 0, {text}, IF({tidy}, {linear}, {stepwise}))")
        + ")"
    )


def extract_entities(entities: str, min_score: float = rules.ENTITY_MIN_SCORE) -> str:
    """Entities above the score, in the listed form."""
    kind = entity_type(f"coalesce(e.entity_group, e.entity, '{rules.UNKNOWN_TYPE}')")
    return (
        f"transform(filter({entities}, e -> coalesce(e.score, 0D) > {min_score}D), "
        f"e -> named_struct('type', {kind}, 'text', coalesce(e.word, ''), "
        "'start', coalesce(e.start, 0), 'end', coalesce(e.end, 0), 'confidence', e.score))"
    )


def merge_bio(text: str, entities: str, max_gap: int = 1) -> str:
    """Merge B-/I- token tags into whole spans; the score is the mean.

    An ``I-`` tag carries on the span before it if the type is the same and
    at most ``max_gap`` characters lie between; otherwise it opens a new one.
    """
    tag = "coalesce(e.entity_group, e.entity)"
    tokens = (
        f"array_sort(transform({entities}, e -> named_struct('start', coalesce(e.start, 0), "
        f"'end', coalesce(e.end, 0), 'label', {entity_type(tag)}, "
        f"'inside', startswith({tag}, 'I-'), 'score', coalesce(e.score, 0D))))"
    )
    # a union's end and label are those of its last tag, so neighbours decide
    apart = f"NOT coalesce(s[i].inside AND s[i].label = s[i - 1].label AND s[i].start - s[i - 1].end BETWEEN 0 AND {max_gap}, false)"
    merged = (
        f"transform({grouped(apart)}, g -> "
        "named_struct('entity_group', g[0].label, 'entity', CAST(NULL AS string), "
        "'score', aggregate(g, 0D, (a, x) -> a + x.score) / size(g), "
        f"'word', {cut_out('bl', 'g[0].start', 'element_at(g, -1).end')}, "
        "'start', g[0].start, 'end', element_at(g, -1).end))"
    )
    some = let("s", tokens, let("bl", blocks(text), merged))
    return f"IF({entities} IS NULL, NULL, IF(size({entities}) = 0, CAST(array() AS {schemas.ENTITIES}), {some}))"


def mask_pii_text(text: str, pii_rules: Sequence[PiiRule] = rules.PII_RULES) -> str:
    """The masked text only, in one expression."""
    return let("ents", detect_entities(text, pii_rules), apply_mask(text, "ents"))


def type_counts(entities: str) -> str:
    """Counts by type of one row's listed entities, as a map."""
    return let(
        "ty",
        f"transform({entities}, e -> e.type)",
        "map_from_entries(transform(array_sort(array_distinct(ty)), "
        "k -> struct(k, CAST(size(filter(ty, v -> v = k)) AS bigint))))",
    )
