"""Small tables with every odd case: nulls, empty and long texts, repeats, clashing columns."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, mix_size string, tox_score string, rule_kept string, wp_n_words string, v string, cid string, h string"


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def prose(rng, n):
    syllables = ["an", "ber", "co", "dé", "el", "fu", "ga", "ho", "in", "ju"]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))


def rows(seed=1, n=60):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text = prose(rng, rng.randint(5, 80))
        if i % 7 == 0 and i:
            text = out[rng.randrange(len(out))][1] or ""
        if i % 11 == 0:
            words = text.split(" ")
            if len(words) > 8:
                words[rng.randrange(len(words))] = "Zz"
            text = " ".join(words)
        out.append((i * 3, text, "en", rng.choice(["a", "b", "c", "é", None, "hot", "hot", "hot"])))
    out += [
        (None, "no id " * 20, "en", "a"),
        (1000, None, None, None),
        (1003, "", "en", "a"),
        (1006, " \t\n\r\x0b\x0c ", "en", "b"),
        (1009, "One", "en", "b"),
        (1012, "one", "en", "b"),
        (1015, prose(rng, 40000), "en", "c"),
        (1018, "x" * 50000, "en", "c"),
        (1021, "same text again and again", "en", "hot"),
        (1021, "same text again and again", "en", "hot"),
        (1024, "same text again and again", "en", "hot"),
        (1027, "a b   c\u0085d\x1ce", "en", "a"),
    ]
    return [(*r, len(r[1]) if r[1] is not None else None, *["x"] * 7) for r in out]


def documents(spark, seed=1, n=60):
    return spark.createDataFrame(rows(seed, n), SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def saved(spark, folder, **tables):
    """A folder of tables as the queries read them."""
    for name, table in tables.items():
        table.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)
