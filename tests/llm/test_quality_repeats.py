"""A share of repeated lines or words of 0.4 to 0.5 rejects a text by itself; one repeated line in a short text doesn't."""

import random

from tessera.llm import quality_rules


def test_repeats_reject_by_themselves(spark):
    rng = random.Random(5)
    words = lambda n: ["".join(rng.choices("aeinrst", k=rng.randint(2, 7))) + str(rng.randrange(10**6)) for _ in range(n)]

    def of_lines(n, twice, between):  # lines of two words, so that no three words repeat
        own = [" ".join(words(2)) for _ in range(n - twice)]
        lines = own + own[:1] * twice
        rng.shuffle(lines)
        return between.join(lines)

    def of_words(n, share):
        half = int(n * share / 2)
        w = words(n - half)
        return " ".join([*w, *w[:half]])

    rows = [(i, "\n".join(" ".join(words(8)) for _ in range(rng.randint(8, 25)))) for i in range(150)]
    bad = [(1000 + k, of_lines(40, int(40 * share), between)) for k, (share, between) in enumerate((s, b) for s in (0.4, 0.45, 0.5) for b in ("\n", "\n\n"))]
    bad += [(2000 + k, of_words(n, share)) for k, (n, share) in enumerate((n, s) for n in (150, 400) for s in (0.42, 0.48))]
    line = " ".join(words(6))
    short = [(3000, "\n".join([line, " ".join(words(30)), " ".join(words(20)), line])), (3001, "\n\n".join([line, " ".join(words(50)), line]))]
    df = spark.createDataFrame([(i, t, "en", "a") for i, t in rows + bad + short], "doc_id long, text string, lang string, source string")
    v = {r.doc_id: r for r in quality_rules.verdicts(df).collect()}
    assert not any(v[i].base_failed for i in v)
    assert [i for i, _ in bad if v[i].kept] == []
    assert [i for i, _ in rows + short if not v[i].kept] == []
