"""Small helpers to write Spark SQL expressions as text.

The detectors are plain SQL expressions.  Kept as text they serve ``F.expr``
and ``CREATE FUNCTION ... RETURN`` alike, so both give the same answer.
Arguments named ``text`` or ``entities`` are SQL expressions: mostly a column
name.
"""

from __future__ import annotations


def lit(value: str) -> str:
    """A string literal that is taken as written: no escapes inside."""
    if "'" not in value:
        return f"r'{value}'"
    if '"' not in value:
        return f'r"{value}"'
    return "concat(" + ", \"'\", ".join(f"r'{p}'" for p in value.split("'")) + ")"


def let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def any_of(words) -> str:
    return ", ".join(lit(w) for w in words)


def holds(text: str, words) -> str:
    """True where the text holds at least one of the literals."""
    return "(" + " OR ".join(f"contains({text}, {lit(w)})" for w in words) + ")"


#: Elements folded at a time; characters of a block, and of a first cut into blocks.
FOLD = 256
BLOCK = 4096
FIRST_CUT = 128 * BLOCK


def running(array: str, zero: str, step: str) -> str:
    """For each element the fold of all before it, as integers; ``step`` joins ``q.l`` and ``x``.

    To add to an array copies it, so the fold goes in blocks.  ``array`` is a name.
    Lambdas are nested as little as can be: each level costs the analyzer a few rounds.
    """
    cuts = (
        f"transform(sequence(0, CAST((size({array}) - 1) div {FOLD} AS int)), "
        f"k -> slice({array}, k * {FOLD} + 1, {FOLD}))"
    )
    inner = (
        "aggregate(b, named_struct('l', r.l, 'o', CAST(array() AS array<int>)), "
        f"(q, x) -> named_struct('l', {step}, 'o', concat(q.o, array(q.l))))"
    )
    joined = let("z", inner, "named_struct('l', z.l, 'o', concat(r.o, array(z.o)))")
    return (
        f"flatten(aggregate({cuts}, named_struct('l', {zero}, 'o', CAST(array() AS array<array<int>>)), "
        f"(r, b) -> {joined}, r -> r.o))"
    )


def blocks(text: str) -> str:
    """The text in blocks of ``BLOCK`` characters, for cuts that need not walk it from the start."""
    def parts(of: str, size: int, index: str) -> str:
        last = f"CAST(greatest(length({of}) - 1, 0) div {size} AS int)"
        return f"transform(sequence(0, {last}), {index} -> substring({of}, {index} * {size} + 1, {size}))"

    return f"flatten(transform({parts(text, FIRST_CUT, 'bi')}, bt -> {parts('bt', BLOCK, 'bj')}))"


def cut_out(blocks: str, start: str, end: str) -> str:
    """The characters from ``start`` to before ``end``, which lie in the text."""
    first, last = f"CAST(({start}) div {BLOCK} AS int)", f"CAST((({end}) - 1) div {BLOCK} AS int)"
    skip = f"CAST(({start}) % {BLOCK} AS int) + 1"
    return (
        f"IF(({end}) <= ({start}), '', IF({first} = {last}, "
        f"substring({blocks}[{first}], {skip}, ({end}) - ({start})), "
        f"concat(substring({blocks}[{first}], {skip}), "
        f"array_join(slice({blocks}, {first} + 2, greatest({last} - {first} - 1, 0)), ''), "
        f"substring({blocks}[{last}], 1, CAST((({end}) - 1) % {BLOCK} AS int) + 1))))"
    )


def grouped(opens: str) -> str:
    """Runs of the array ``s``, which is not empty; one begins where ``opens`` holds for index ``i``."""
    starts = f"filter(sequence(0, size(s) - 1), i -> i = 0 OR ({opens}))"
    runs = "transform(go, (g, k) -> slice(s, g + 1, coalesce(get(go, k + 1), size(s)) - g))"
    return let("go", starts, runs)
