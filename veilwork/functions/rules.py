"""Default detection rules, stated as data.

Patterns use only what Java regexes and RE2 share, apart from the explicit
ASCII word edges below: Java's own ``\\b`` also looks at accented letters, RE2's
does not, and a mask must not depend on the engine.  (``\\w`` is ASCII in both.)

``first`` lists the characters a match can start with.  They become a
one-character look-ahead in front of the pattern, so a position that cannot
start a match costs one character test instead of a walk through alternations.
The characters are written out: Java tests a class of single Latin-1
characters by one table look-up, but one of ranges range by range.  ``needs``
names literals of which a matching text must hold at least one; those of the
injection rules are words, and stand behind a word edge.
"""

from __future__ import annotations

from dataclasses import dataclass
from string import ascii_letters, digits

EDGE_L = r"(?<!\w)"
EDGE_R = r"(?!\w)"


def one_of(chars: str) -> str:
    """A character class of these characters."""
    return "[" + "".join("\\" + c if c in "[]\\^-&" else c for c in sorted(set(chars))) + "]"


def _ahead(first: str, pattern: str) -> str:
    return f"(?={one_of(first)})(?:{pattern})" if first else pattern


@dataclass(frozen=True)
class PiiRule:
    label: str
    first: str
    pattern: str
    score: float = 0.9
    needs: tuple[str, ...] = ()
    in_line: bool = False  # every match lies in one line and holds a digit or an @: looked for there alone

    @property
    def regex(self) -> str:
        return _ahead(self.first, self.pattern)


@dataclass(frozen=True)
class InjectionRule:
    family: str
    weight: float
    first: str
    pattern: str  # matched against lower-cased text
    needs: tuple[str, ...] = ()

    @property
    def regex(self) -> str:
        return _ahead(self.first, self.pattern)


# ---- fixed values -------------------------------------------------------
# Entity types, label sets, thresholds, statuses and defaults that results
# must agree on.

GIVEN_NAMES = (
    "Alice", "Amanda", "David", "Emily", "François", "James", "Jane",
    "Jennifer", "John", "Lisa", "Maria", "Michael", "Robert", "Sarah",
)
TITLES = ("Dr", "Mr", "Mrs", "Ms")
MONTHS = (
    "January", "February", "March", "April", "May", "June", "July", "August",
    "September", "October", "November", "December",
)
ID_PREFIXES = ("MRN", "MED", "PAT", "CUST", "EMP", "ACC", "ORD", "INV")
STREET_WORDS = (
    "Street", "St", "Avenue", "Ave", "Road", "Rd", "Boulevard", "Terrace",
    "Center", "Lane", "Drive",
)

INJECTION_LABELS = ("INJECTION", "MALICIOUS", "UNSAFE")
SAFE_LABELS = ("SAFE", "BENIGN", "CLEAN")
ENTITY_MIN_SCORE = 0.5
INJECTION_THRESHOLD = 0.5
CLASS_INJECTION = "INJECTION_DETECTED"
CLASS_SAFE = "SAFE"
UNKNOWN_TYPE = "UNKNOWN"
STATUS_FAILED = "failed"
STATUS_OK = "ok"
OPERATIONS = ("mask_pii", "detect_injection")
DEFAULT_BATCH_SIZE = 10
#: Token limits of the model service: of one text, of a batch (padded), and rows of a batch.
MAX_INPUT_TOKENS = 1024
MAX_BATCH_TOKENS = 8192
MAX_BATCH_ROWS = 64
CAPTURE_PERCENT = 10
RETRY_CODES = (
    "ThrottlingException", "ServiceUnavailable", "TooManyRequestsException",
)
MAX_RETRIES = 3
RETRY_DELAY = 1.0
RETRY_BACKOFF = 2.0
# mean text length below the first number -> batch size
BATCH_SIZE_STEPS = ((100, 64), (500, 32))
BATCH_SIZE_ELSE = 16
RESPONSE_BANDS = ((0.9, "block"), (0.5, "review"), (0.2, "log"))
RESPONSE_ELSE = "allow"
# -------------------------------------------------------------------------


def _any(words) -> str:
    return "|".join(words)


def person_rule(names=GIVEN_NAMES) -> PiiRule:
    """Titled names, and a known given name followed by a capitalised word."""
    initials = "".join(sorted({w[0] for w in (*TITLES, *names)}))
    return PiiRule(
        "PERSON",
        initials,
        rf"{EDGE_L}(?:{_any(TITLES)})\. \p{{Lu}}\p{{L}}+(?: \p{{Lu}}\p{{L}}+)?"
        rf"|{EDGE_L}(?:{_any(names)}) \p{{Lu}}\p{{L}}+",
        in_line=False,
    )


# Order is priority: where spans of two rules overlap, the earlier rule names
# the joined span.
PII_RULES = (
    PiiRule(
        # One attempt per run of local-part characters, and none inside it:
        # linear on long unbroken runs.  \G lets a match start right behind
        # the one before.
        "EMAIL",
        ascii_letters + digits + "._%+-",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++"
        r"@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
        needs=("@",), in_line=True,
    ),
    PiiRule("SSN", digits, rf"{EDGE_L}\d{{3}}-\d{{2}}-\d{{4}}{EDGE_R}", needs=("-",), in_line=True),
    PiiRule(
        "CREDIT_CARD",
        digits,
        rf"{EDGE_L}(?:\d{{4}}[- ]){{3}}\d{{4}}{EDGE_R}|{EDGE_L}\d{{16}}{EDGE_R}",
        in_line=True,
    ),
    PiiRule(
        "PHONE_NUMBER",
        "+(" + digits,
        rf"(?:\+1[ -])?\(\d{{3}}\) ?\d{{3}}-\d{{4}}{EDGE_R}"
        rf"|{EDGE_L}\d{{3}}-\d{{3}}-\d{{4}}{EDGE_R}"
        rf"|\+\d{{1,3}}(?: \d{{2,10}}){{1,4}}{EDGE_R}"
        rf"|{EDGE_L}555-\d{{4}}{EDGE_R}",
        in_line=True,
    ),
    PiiRule(
        "IPV4", digits, rf"{EDGE_L}\d{{1,3}}(?:\.\d{{1,3}}){{3}}{EDGE_R}", needs=(".",), in_line=True
    ),
    PiiRule(
        "DATE",
        digits + "JFMASOND",
        rf"{EDGE_L}\d{{1,2}}/\d{{1,2}}/\d{{4}}{EDGE_R}"
        rf"|{EDGE_L}(?:{_any(MONTHS)}) \d{{1,2}}(?:, \d{{4}})?{EDGE_R}",
        in_line=True,
    ),
    PiiRule(
        "ID",
        "MPCEAOI",
        rf"{EDGE_L}(?:{_any(ID_PREFIXES)})-?\d[\d-]*\d{EDGE_R}",
        in_line=True,
    ),
    PiiRule(
        "ADDRESS",
        digits,
        rf"{EDGE_L}\d{{1,5}} (?:\p{{Lu}}\p{{L}}+ ){{1,3}}(?:{_any(STREET_WORDS)}){EDGE_R}"
        r"(?:, \p{Lu}\p{L}+(?: \p{Lu}\p{L}+)?(?:, [A-Z]{2}(?: \d{5})?)?)?",
        in_line=True,
    ),
    person_rule(),
)

INJECTION_RULES = (
    InjectionRule(
        "override", 0.9, "ifd",
        rf"{EDGE_L}(?:ignore|forget|disregard){EDGE_R}[^\n]{{0,20}}"
        rf"{EDGE_L}(?:instructions?|rules?|everything|safety protocols){EDGE_R}",
        ("ignore", "forget", "disregard"),
    ),
    InjectionRule(
        "override", 0.8, "bo",
        rf"{EDGE_L}(?:bypass|override){EDGE_R}[^\n]{{0,40}}"
        rf"{EDGE_L}(?:protocols?|filters?|restrictions?|directive){EDGE_R}",
        ("bypass", "override"),
    ),
    InjectionRule(
        "exfiltration", 0.8, "rlpstq",
        rf"{EDGE_L}(?:reveal|leak|print|repeat|show|tell me|quote){EDGE_R}[^\n]{{0,40}}"
        rf"{EDGE_L}(?:system prompt|system message|system text|training data|configuration"
        rf"|rules|user data|database|secrets|everything above|verbatim){EDGE_R}",
        ("reveal", "leak", "print", "repeat", "show", "tell me", "quote"),
    ),
    InjectionRule(
        "exfiltration", 0.7, "v",
        rf"{EDGE_L}verbatim{EDGE_R}[^\n]{{0,40}}{EDGE_L}system{EDGE_R}",
        ("verbatim",),
    ),
    InjectionRule(
        "role", 0.8, "s{",
        r"(?<![^ \t\r\n\f\]}])system(?: command| override)?:|\{\{ ?system ?\}\}",
        ("system",),
    ),
    InjectionRule(
        "role", 0.8, "apy",
        rf"{EDGE_L}(?:act as|pretend to be|you are now){EDGE_R}[^\n]{{0,60}}"
        rf"{EDGE_L}(?:ai|dan|mode|restrictions|guidelines){EDGE_R}",
        ("act as", "pretend to be", "you are now"),
    ),
    InjectionRule(
        "jailbreak", 0.7, "nr",
        rf"{EDGE_L}no (?:restrictions|ethical guidelines){EDGE_R}"
        rf"|{EDGE_L}rules are suspended{EDGE_R}",
        ("no restrictions", "no ethical guidelines", "rules are suspended"),
    ),
    InjectionRule(
        "override", 0.6, "n", rf"{EDGE_L}new (?:task|directive){EDGE_R}",
        ("new task", "new directive"),
    ),
    InjectionRule(
        "mixed", 0.7, "p",
        rf"{EDGE_L}prompt injection{EDGE_R}[^\n]{{0,40}}{EDGE_L}perform{EDGE_R}",
        ("prompt injection",),
    ),
)

# Before matching, format characters go and any white space is one blank, so that
# neither a line break nor an unseen character hides a phrase.
UNSEEN = r"\p{Cf}+"
BLANKS = r"[ \t\n\x0B\f\r\x{A0}\x{2028}\x{2029}]+"

# A phrase in quotes is talked about, not said.  \x22 and \x27 are the quotes.
QUOTABLE = "ignore previous instructions"
QUOTED_PHRASE = rf"[\x22\x27]{QUOTABLE}[\x22\x27]"
ASKING_FOR_HELP = rf"{EDGE_L}how (?:do|can) i (?:protect|defend|prevent){EDGE_R}"
