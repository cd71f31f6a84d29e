"""Small corpora with the cases every operator must survive."""

from __future__ import annotations

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, fp string, u int"
WORDS = {
    "en": "the of and to in that it was for on with as his they at be this from have or one had by word but not what all were we when your can said there use an each which she do how their if will up other about out many then them these so some her would make like him into time has look two more write go see number no way could people my than first water been call who oil its now find long down day did get come made may part".split(),
    "de": "der die das und ist nicht von sie mit sich des auf für im dem ein eine als auch es an werden aus er hat dass wir wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei kann gegen vom können schon wenn habe seine ihre dann unter uns soll ich eines jahr zwei jahren diese dieser wieder keine seiner worden will zwischen immer millionen".split(),
}


def prose(seed: int, n: int, lang: str = "en") -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS[lang]) + ("." if rng.random() < 0.1 else "") for _ in range(n))


def row(i, text, lang="en", source="s0"):
    return (i, text, lang, source, len(text or ""), 0.5, "x", 7)


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def odd(spark):
    """Nulls everywhere, empty and blank texts, a very long text, ties and repeated rows."""
    long = prose(99, 60_000)
    rows = [row(i, prose(i, 40 + i, "en" if i % 3 else "de"), "en" if i % 3 else "de", f"s{i % 4}") for i in range(24)]
    rows += [row(100, None, None, None), row(101, "", "en", None), row(102, " \t\n ", "de", "s0"), row(103, long), (None, prose(1, 41), None, None, None, None, None, None)]
    rows += [rows[3], rows[3], row(104, rows[4][1]), row(105, "ÉÀ ß 你好 мир"), row(106, "x" * 5000), row(107, "12345 !!")]
    return docs(spark, rows)
