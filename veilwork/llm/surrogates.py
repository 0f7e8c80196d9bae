"""Surrogates for personal data: keyed, of the same type, distinct and the same everywhere.

A surrogate hangs on the key, the type and the normal form of the entity alone,
so all mentions of one entity, in any document, get the same one.  It keeps the
format: letters for letters, digits for digits, punctuation in place, card
check digits valid, names of the same gender and script.  Two entities must not
get one surrogate, nor one the value of a real entity: all distinct entities
are checked, and those that lose are drawn again until none is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veilwork.llm.common import cut, join_small, packed, unpacked

#: Stands between pieces while a text is taken apart; its own uses are escaped.
MARK = "﷐"

_NAME = r"\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?(?:[  ]\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?){0,2}"
#: Forms of address that give the gender.
_MALE = "Mr|Mr\\.|Sir|Herr|Herrn|Monsieur|M\\.|Señor|Sr\\.|господин|г-н"
_FEMALE = "Mrs|Mrs\\.|Ms|Ms\\.|Miss|Frau|Madame|Mme|Señora|Sra\\.|госпожа|г-жа"
#: What stands in front of a secret: its name in any case, "=" or ":", and blanks and quotes around that.
_SECRET = r"(?i:password|passwd|secret|api[_\-]?key|token)[\"']?[ \t]{0,3}[=:][ \t]{0,3}[\"']?"

#: code letter, name, pattern with no group; earlier ones win at the same place.
TYPES = (
    ("a", "email", r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)+"),
    ("b", "secret", rf"(?<=[=:\"' \t])(?<=[=:][ \t]{{0,3}}[\"']?)(?=[A-Za-z0-9_\-]{{8}})(?<={_SECRET})(?!AKIA[A-Z0-9]{{16}}(?![A-Za-z0-9_\-]))[A-Za-z0-9_\-]++"),
    ("h", "key", r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"),
    ("c", "ipv4", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\d|\.\d)"),
    ("d", "phone", r"(?<![\d+])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .\-]?\d{2,4}){2,4}(?!\d)|(?<![\d(+\-.])(?:\(\d{3}\) ?|\d{3}[ .\-])\d{3}[ .\-]\d{4}(?![\d\-])"),
    ("e", "ssn", r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"),
    ("f", "card", r"(?<![\d.\-])\d(?:[ \-]?\d){12,18}(?![\d\-])"),
    ("g", "iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("m", "male", rf"(?=\p{{Lu}})(?<=[  ])(?<=(?<![\p{{L}}\-])(?:{_MALE})[  ]){_NAME}"),
    ("w", "female", rf"(?=\p{{Lu}})(?<=[  ])(?<=(?<![\p{{L}}\-])(?:{_FEMALE})[  ]){_NAME}"),
)
CODES = "".join(code for code, _, _ in TYPES)


def _joint(email: bool) -> str:
    """All types in one pattern.  Most characters of a text can begin none of them, and
    one test says so of all but the first two."""
    groups = [f"({pattern})" for _, _, pattern in TYPES]
    if not email:
        groups[0] = "((?!))"
    return f"{groups[0]}|{groups[1]}|(?=[0-9(+\\p{{Lu}}])(?:{'|'.join(groups[2:])})"


PATTERN, PATTERN_NO_EMAIL = _joint(True), _joint(False)
_OUT = "".join(f"{MARK}{code}${i + 1}" for i, (code, _, _) in enumerate(TYPES)) + f"{MARK}z"

#: Syllables and endings of made-up names, by script and gender.
_SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga ge ka ke la le lo ma me mi na ne no ra re ro sa se ta te va vo".split(),
    "cyrillic": "ба бе бо да де до фа фе га ге ка ке ла ле ло ма ме ми на не но ра ре ро са се та те ва во".split(),
}
_ENDINGS = {
    ("latin", "m"): "n r s l".split(), ("latin", "w"): "na ra la lia".split(),
    ("latin", "s"): "ner son sen lin".split(),
    ("cyrillic", "m"): "н р с л".split(), ("cyrillic", "w"): "на ра ла лия".split(),
    ("cyrillic", "s"): "нер сон сен лин".split(),
}


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _chars(s: Column) -> Column:
    return F.split(s, "")


def _draw(digest: Column, i: Column, n: int) -> Column:
    """The i-th keyed number below n."""
    return F.pmod(F.xxhash64(digest, i), F.lit(n)).cast("int")


def _same_kind(body: Column, digest: Column, kind: Column) -> Column:
    """Letters for letters and digits for digits; phone numbers go on with 2 to 9."""
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    one = lambda alphabet, at: F.substring(F.lit(alphabet), at + 1, F.lit(1))
    return F.array_join(F.transform(
        _chars(body),
        lambda c, i: F.when(c.rlike("[0-9]"), F.when((i == 0) & (kind == "d"), one(dig[2:], _draw(digest, i, 8)))
                            .otherwise(one(dig, _draw(digest, i, 10))))
        .when(c.rlike("[a-z]"), one(low, _draw(digest, i, 26)))
        .when(c.rlike("[A-Z]"), one(up, _draw(digest, i, 26))).otherwise(c),
    ), "")


def luhn(digits: Column) -> Column:
    """Sum modulo 10 of the card check over a string of digits."""
    worth = F.transform(
        F.reverse(_chars(digits)),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).when(c.cast("int") > 4, c.cast("int") * 2 - 9)
        .otherwise(c.cast("int") * 2),
    )
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10


def _name(norm: Column, digest: Column, kind: Column, attempt: Column) -> Column:
    """Syllables of the script, one more with each draw, and an ending of the gender."""
    script = F.when(norm.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).otherwise(F.lit("latin"))
    letters = lambda x: F.array(*[F.lit(y) for y in x])
    syllables = F.when(script == "latin", letters(_SYLLABLES["latin"])).otherwise(letters(_SYLLABLES["cyrillic"]))
    endings = F.lit(None).cast("array<string>")
    for (of, gender), values in _ENDINGS.items():
        endings = F.when((script == of) & (kind == gender), letters(values)).otherwise(endings)
    stem = _let(syllables, lambda all_: F.array_join(F.transform(
        F.sequence(F.lit(0), F.lit(2) + F.least(attempt, F.lit(6))),
        lambda i: F.get(all_, _draw(digest, i, len(_SYLLABLES["latin"]))),
    ), ""))
    return F.concat(stem, F.get(endings, _draw(digest, F.lit(99), 4)))


def _octets(norm: Column, digest: Column, attempt: Column) -> Column:
    """Octets of as many digits as before; of any size from the ninth draw on."""
    def one(x: Column, i: Column) -> Column:
        d = lambda n: _draw(digest, i, n)
        return (
            F.when(attempt > 8, d(254) + 1).when(F.length(x) == 1, d(9) + 1)
            .when(F.length(x) == 2, d(90) + 10).otherwise(d(156) + 100)
        ).cast("string")

    return F.array_join(F.transform(F.split(norm, r"\."), one), ".")


def _drawn(kind: Column, norm: Column, attempt: Column, digest: Column) -> Column:
    """What is kept at either end, and the rest drawn anew."""
    top = F.substring_index(norm, ".", -1)
    longer = F.when((attempt > 3) & kind.isin("a", "b", "h"), attempt.cast("string")).otherwise(F.lit(""))
    head = (
        F.when(kind == "h", F.lit(4)).when(kind == "g", F.lit(2))
        # short phone numbers may run out of those with the same first digit
        .when((kind == "f") | ((kind == "d") & (attempt <= 8)), F.lit(1)).otherwise(F.lit(0))
    )
    tail = F.when(kind == "a", F.length(top)).when(kind == "f", F.lit(1)).otherwise(F.lit(0))

    def checked(body: Column) -> Column:
        end = F.when(kind == "a", top).when(
            kind == "f", F.pmod(F.lit(10) - luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
        ).otherwise(F.lit(""))
        return F.concat(longer, body, end)

    return _let(head, lambda h: _let(
        F.concat(
            F.substring(norm, F.lit(1), h),
            _same_kind(F.substring(norm, h + 1, F.length(norm) - h - tail), digest, kind),
        ),
        checked,
    ))


def draw(secret: str, kind: Column, norm: Column, attempt: Column) -> Column:
    """The surrogate, in normal form, of an entity in normal form."""
    digest = F.sha2(F.concat_ws("\x01", F.lit(secret), kind, norm, attempt.cast("string")), 256)
    return _let(
        F.struct(digest.alias("d"), kind.alias("k"), norm.alias("n"), attempt.alias("a")),
        lambda x: F.when(x["k"] == "c", _octets(x["n"], x["d"], x["a"]))
        .when(x["k"].isin("m", "w", "s"), _name(x["n"], x["d"], x["k"], x["a"]))
        .otherwise(_drawn(x["k"], x["n"], x["a"], x["d"])),
    )


def normal(kind: Column, mention: Column) -> Column:
    return (
        F.when(kind.isin("d", "e", "f"), F.regexp_replace(mention, "[^0-9]", ""))
        .when(kind == "g", F.replace(mention, F.lit(" "), F.lit("")))
        .when(kind.isin("a", "m", "w", "s"), F.lower(mention)).otherwise(mention)
    )


def _lay(mention: Column, plain: Column, char: Column) -> Column:
    """Characters of ``plain`` in the places where the mention has one like ``char``."""
    place = lambda i: F.size(F.filter(
        _chars(F.substring(mention, F.lit(1), i + 1)), lambda c: F.rlike(c, char)
    ))
    return F.array_join(F.transform(
        _chars(mention), lambda c, i: F.when(F.rlike(c, char), F.substring(plain, place(i), F.lit(1))).otherwise(c),
    ), "")


def pieces(text: Column) -> Column:
    """The text in pieces: the first is plain, the others begin with a code letter."""
    safe = F.replace(text, F.lit(MARK), F.lit(MARK + "y"))
    marked = F.when(F.contains(text, F.lit("@")), F.regexp_replace(safe, PATTERN, _OUT)).otherwise(
        F.regexp_replace(safe, PATTERN_NO_EMAIL, _OUT)
    )
    return F.split(marked, MARK, -1)


def _is_card(kind: Column, mention: Column) -> Column:
    return (kind != "f") | (luhn(normal(F.lit("f"), mention)) == 0)


def _parts(piece: Column) -> Column:
    """(kind, normal form) of the entities of a piece: of a name, each word."""
    kind, mention = F.substring(piece, 1, 1), F.substring(piece, F.lit(2), F.length(piece))
    names = F.split(mention, "[  ]")
    of_names = F.transform(names, lambda x, i: F.struct(
        F.when(i == F.size(names) - 1, F.lit("s")).otherwise(kind).alias("kind"),
        F.lower(x).alias("norm"),
    ))
    return (
        F.when((F.length(piece) < 2) | kind.isin("y", "z") | ~_is_card(kind, mention),
               F.array().cast("array<struct<kind:string,norm:string>>"))
        .when(kind.isin("m", "w"), of_names)
        .otherwise(F.array(F.struct(kind.alias("kind"), normal(kind, mention).alias("norm"))))
    )


def _document(key: str, text: str) -> Column:
    """What a row is joined by: its key, or the digest of its text where the key is null."""
    digest = F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"), 256)
    return F.coalesce(F.concat(F.lit("k"), F.col(f"`{key}`").cast("string")), F.concat(F.lit("t"), digest))


def entities(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kind, norm) of every mention."""
    found = docs.select(
        _document(key, text).alias("k"),
        F.explode(F.array(pieces(F.coalesce(F.col(f"`{text}`"), F.lit(""))))).alias("p"),
    ).where(F.size("p") > 1)
    rest = F.slice("p", F.lit(2), F.size("p") - 1)
    # nothing but the marked pieces goes on
    marked = F.filter(rest, lambda x: (F.length(x) > 1) & ~F.substring(x, 1, 1).isin("y", "z"))
    found = found.select("k", F.explode(marked).alias("x"))
    return found.select("k", F.explode(_parts(F.col("x"))).alias("e")).select("k", "e.kind", "e.norm")


def settle(found: DataFrame, secret: str, rounds: int = 50) -> DataFrame:
    """(kind, norm, attempt) of the entities whose first draw was taken; written.

    Each round, of those that share a surrogate the one settled first (then the
    smallest) keeps it, and none keeps the value of a real entity of its kind.
    Rounds go on until none has to move.  If some still have to after ``rounds``
    (a kind with about as many entities as surrogates), that is an error, as two
    entities would share one.
    """
    claims = cut(
        found.select("kind", "norm").distinct().select(
            "kind", "norm", F.lit(0).alias("attempt"),
            draw(secret, F.col("kind"), F.col("norm"), F.lit(0)).alias("made"),
        ),
        "pii-claims",
    )
    for number in range(rounds):
        holder = claims.groupBy("kind", "made").agg(F.min(F.struct("attempt", "norm")).alias("h"))
        holder = holder.select("kind", "made", F.col("h.norm").alias("held_by"))
        real = claims.select("kind", F.col("norm").alias("made"), F.lit(True).alias("real"))
        judged = claims.join(holder, ["kind", "made"]).join(real, ["kind", "made"], "left")
        moves = (F.col("held_by") != F.col("norm")) | F.col("real").isNotNull()
        judged = judged.withColumn("moves", moves)
        attempt = F.when(F.col("moves"), F.lit(number + 1)).otherwise(F.col("attempt"))
        moved = judged.select("kind", "norm", "moves", attempt.alias("attempt"), "made")
        moved = moved.withColumn(
            "made",
            F.when(F.col("moves"), draw(secret, F.col("kind"), F.col("norm"), F.col("attempt")))
            .otherwise(F.col("made")),
        )
        claims = cut(moved, "pii-claims")
        if claims.where("moves").isEmpty():
            break
        claims = claims.drop("moves")
    else:
        kinds = {code: name for code, name, _ in TYPES} | {"s": "surname"}
        left = judged.where("moves").groupBy("kind").count().orderBy("kind").collect()
        raise ValueError(f"no surrogates of their own after {rounds} rounds: " + ", ".join(
            f"{r['count']} of kind {kinds.get(r['kind'], r['kind'])}" for r in left
        ))
    return cut(claims.where("attempt > 0").select("kind", "norm", "attempt"), "pii-again")


def _replaced(piece: Column, again: Column, secret: str) -> Column:
    made = F.transform(_parts(piece), lambda e: draw(
        secret, e["kind"], e["norm"],
        F.coalesce(F.element_at(again, F.concat(e["kind"], e["norm"])), F.lit(0)),
    ))

    def put(x: Column) -> Column:
        kind, mention, drawn = x["k"], x["m"], F.get(x["d"], F.lit(0))
        spaces = F.regexp_extract_all(mention, F.lit("[  ]"), F.lit(0))
        named = F.array_join(F.transform(
            x["d"], lambda y, i: F.concat(F.initcap(y), F.coalesce(F.get(spaces, i), F.lit("")))
        ), "")
        return (
            F.when(kind == "y", F.concat(F.lit(MARK), mention))
            .when(F.size(x["d"]) == 0, mention)
            .when(kind.isin("d", "e", "f", "g"), _lay(mention, drawn, F.when(kind == "g", F.lit("[A-Z0-9]")).otherwise(F.lit("[0-9]"))))
            .when(kind.isin("m", "w"), named)
            .when((kind == "a") & (mention == F.upper(mention)), F.upper(drawn)).otherwise(drawn)
        )

    return _let(
        F.struct(F.substring(piece, 1, 1).alias("k"),
                 F.substring(piece, F.lit(2), F.length(piece)).alias("m"), made.alias("d")),
        put,
    )


def replace_entities(docs: DataFrame, secret: str, key: str = "doc_id", text: str = "text",
                     count: str = "n_entities") -> DataFrame:
    """The table with surrogates in ``text`` and the number of replaced mentions in ``count``.

    Null texts stay null, with 0 entities; empty ones stay empty.  Rows are
    replaced one by one, whatever their key (null and repeated keys too).  An
    empty table gives an empty one.  A column named as ``count`` gives way, all
    others stay.  ``secret`` is the key: with another one all surrogates differ.

    Texts are read twice and never shuffled unless the entities drawn again
    (grouped by document) are too many bytes for a broadcast.
    """
    found = cut(entities(docs, key, text), "pii-mentions")
    again = settle(found, secret)
    side = cut(
        join_small(found, again, ["kind", "norm"], "inner")
        .select("k", F.struct(F.concat("kind", "norm").alias("key"), "attempt").alias("e"))
        .groupBy("k").agg(F.map_from_entries(F.collect_set("e")).alias("again")),
        "pii-documents",
    )
    out = join_small(packed(docs, but=(text,), k=_document(key, text), t=F.col(f"`{text}`")), side, ["k"], "left")
    body = F.explode(F.array(pieces(F.coalesce(F.col("t"), F.lit("")))))
    out = out.select("row", "t", F.coalesce("again", F.create_map().cast("map<string,int>")).alias("again"), body.alias("p"))
    rest = F.slice("p", F.lit(2), F.size("p") - 1)
    new = F.concat(F.get("p", F.lit(0)), F.array_join(F.transform(rest, lambda x: _replaced(x, F.col("again"), secret)), ""))
    hits = F.size(F.filter(rest, lambda x: (F.length(x) > 1) & ~F.substring(x, 1, 1).isin("y", "z")
                           & _is_card(F.substring(x, 1, 1), F.substring(x, F.lit(2), F.length(x)))))
    names = [c for c in docs.columns if c != count]
    return out.select(*unpacked(names, **{text: F.when(F.col("t").isNotNull(), new)}), hits.cast("long").alias(count))
