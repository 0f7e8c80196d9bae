"""Quality counts and chat windows on odd rows, beside plain versions."""

import hashlib
import re

from veilwork.llm import chat, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    t = text or ""
    w = WORD.findall(t)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    covered = {i + d for i, g in enumerate(grams) if grams.count(g) > 1 for d in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))


def test_quality(spark):
    plain = " ".join(f"wort{i}" for i in range(80))
    texts = [
        None, "", " ", "a b c a b c", "x\ny\nx\n\n\n x", "a b c", plain, plain.upper(), plain + " ###" * 20,
        "a b a b a b a b", "\n".join([plain] * 3), "1 2 3 " * 30, "😀 é " * 40, "q " * 3000, "z" * 100_000,
        " ".join(f"{i}" for i in range(100)), plain + "!" * 60, " ".join("y" * 30 + str(i) for i in range(60)),
    ]
    df = spark.createDataFrame([(i if i else None, t, 0, "x") for i, t in enumerate(texts)],
                               "doc_id long, text string, n_words int, w string")
    got = {r["doc_id"] or 0: r for r in quality.quality_cascade(df).collect()}
    for i, text in enumerate(texts):
        r = got[i]
        assert tuple(r)[1:6] == counts(text), (i, tuple(r))
        n, _, _, _, repeated = counts(text)
        assert r["base_failed"] == (n < 50 or 100 * repeated > 50 * n)
        assert not (r["base_failed"] and r["kept"])
    assert [i for i in range(len(texts)) if got[i]["kept"]] == [6]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert quality.quality_cascade(none).collect() == []


def test_order_by_rejections_per_cost(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, f"w{i} " * 60) for i in range(300)], "doc_id long, text string")
    never = quality.Rule("never", F.length(F.regexp_replace("t", "(w|[0-9])+ ", "")) > 10**6)
    always = quality.Rule("always", F.col("n_words") > 0)
    ordered = quality.order_rules(df, [never, always], fraction=1.0)
    assert [r.name for r in ordered] == ["always", "never"]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        said = "".join(t for _, _, role, t in turns if role == "assistant")
        out[conv] = (len(turns), digest("".join(f"{role}\n{t}\n" for _, _, role, t in turns)), len(said), digest(said))
    return out


def test_chat_round_trip_and_budget(spark):
    odd = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\nhi", "back\\slash \\| <\\| [\\INST]", "<|<|</<s>", "", None,
           "␤n ␤.\n", "😀 <|endoftext|>", "[[INST]]", "\\"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(odd)]
    rows += [(2, 0, "system", "be short")] + [(2, i, ["user", "assistant"][i % 2], f"w{i} " * (i % 50)) for i in range(1, 200)]
    rows += [(3, 0, "system", "alone")] + [(4, 0, "assistant", "x " * 5000), (4, 1, "user", "y")]
    rows += [(5, None, None, "t"), (5, 1, "a\nb␤", "same"), (5, 1, "a\nb␤", "same"), (None, 0, "user", "q")]
    rows += [(6, 0, "system", "s " * 2000), (6, 1, "user", "u"), (6, 2, "assistant", "v " * 90)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, window int")
    windows = chat.format_chat(df.repartition(3), budget=200, history=40)
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(windows).collect()}
    assert got == expected(rows)
    shown = windows.collect()
    assert sum(len(r["formatted"]) for r in shown if r["conv_id"] == 2) == [
        r["formatted_chars"] for r in chat.read_back(windows).collect() if r["conv_id"] == 2][0]
    for r in shown:
        blocks = r["formatted"].split("<|im_end|>\n")[:-1]
        assert all(b.startswith("<|im_start|>") and "<|" not in b[12:] for b in blocks)
        tokens = sum(len(WORD.findall(b.split("\n", 1)[1])) + chat.TURN_TOKENS for b in blocks)
        single = len(blocks) - r["n_repeated"] == 1
        assert tokens <= 200 or single or r["conv_id"] == 6
    two = sorted((r["window"], r["formatted"], r["n_repeated"]) for r in shown if r["conv_id"] == 2)
    assert all(f.startswith("<|im_start|>system\nbe short") for _, f, _ in two)
    assert any(n > 1 for _, _, n in two[1:])
    assert chat.format_chat(df.limit(0)).collect() == []
