"""Every disguise of every learned word, and that plain texts stay clean."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from oncemore.llm import toxicity

WORDS = ["trash", "idiot", "pathetic", "worthless", "loser", "scum", "disgusting", "moron", "stupid", "clown"]
PLAIN = "you are the real thing and we like what they said about it on the way home letter off all good bell see too".split()
LEET = str.maketrans("oieast", "013457")
SIGNS = str.maketrans("asitcl", "@$!+(|")

DISGUISES = {
    "plain": lambda w: w,
    "capitals": str.upper,
    "a letter doubled": lambda w: w[0] + w[1] * 2 + w[2:],
    "the last letter doubled": lambda w: w + w[-1],
    "every letter doubled": lambda w: "".join(c * 2 for c in w),
    "a letter four times": lambda w: w[:2] + w[2] * 4 + w[3:],
    "leet": lambda w: w.translate(LEET),
    "signs": lambda w: w.translate(SIGNS),
    "leet in quotes": lambda w: f'"{w.translate(LEET)}",',
    "leet in single characters": lambda w: " ".join(w.translate(LEET)),
    "doubled single characters": lambda w: " ".join(c * 2 for c in w),
    "a sign inside": lambda w: f"{w[:2]}-{w[2:]}",
    "a blank inside": lambda w: f"{w[:2]} {w[2:]}",
    "a line break inside": lambda w: f"{w[:3]}\n{w[3:]}",
    "after a single letter": lambda w: "a " + " ".join(w),
    "an exclamation": lambda w: f"({w}!!!)",
} | {f"split by {sep!r}": lambda w, sep=sep: sep.join(w) for sep in " .,-_/~|*\n\t\xa0"}


@pytest.fixture(scope="module")
def scorer(spark):
    # Each text in an order of its own: near copies count once.
    rng = random.Random(1)
    rows = [(k, [*PLAIN, f"number{k}", *(WORDS if k % 4 == 0 else ["nothing"])]) for k in range(200)]
    docs = spark.createDataFrame([(k, " ".join(rng.sample(t, len(t)))) for k, t in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(200)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    assert set(WORDS) == set(model.words) and {"you", "home"} <= set(model.common)
    return toxicity.Scorer(model)


@pytest.mark.parametrize("name", DISGUISES)
def test_disguise(scorer, name):
    for w in WORDS:
        for text in ("you are the {} real thing", "{}", "see {}", "{} home"):
            assert scorer.hits(text.format(DISGUISES[name](w))) == 1, (w, text)


def test_places_count_once(scorer):
    assert scorer.hits("idiot i-d-i-o-t 1d10t i d i o t") == 4
    assert scorer.hits("IDIOT, idiot; iidioott") == 3


@pytest.mark.parametrize("sign", ["!d!0t", "|0$3r", "+rash", "idio+", '"1d107"'])
def test_look_alikes_at_the_edges(scorer, sign):
    assert scorer.hits(f"so {sign} then") == 1


def test_clean_texts(scorer):
    clean = [
        "", " ", "a b c d e f g", "1 2 3 4 5 6", "1,024.50 - 3/4 of 2024-10-05", "I, a. b) c) d)", "!!! ??? *** |||",
        " ".join(PLAIN * 3), "e.g. i.e. a.m. p.m. U.S.A.", "x = y + z; a[i] = b[j]", "wi-fi well-known co-op", "über naïve café",
    ]
    assert [scorer.hits(t) for t in clean] == [0] * len(clean)


def test_words_of_the_corpus_are_not_joined(scorer):
    """What two common words make together is no disguise."""
    model = toxicity.Model(["thetic", "seehome"], common=["see", "home"])
    joined = toxicity.Scorer(model)
    assert joined.hits("see home") == 0 and joined.hits("th etic") == 1


def test_long_text_and_many_tokens(scorer, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_CACHED", 50)
    text = " ".join(f"w{k} word{k}" for k in range(20_000)) + " st.u.pid " + "z" * 200_000
    assert scorer.hits(text) == 1 == scorer.hits(text)


def test_forms_that_are_rare_each(spark):
    """Each form of a toxic word is in 4 % of the toxic documents; of the other words, some are in toxic ones only."""
    rng = random.Random(4)
    forms = [f"{stem}{end}" for stem in ("lowei", "vequ") for end in ("sse", "and", "ero", "mo", "ta", "isp", "ais", "eur", "ent", "ung", "ich", "art", "ien")]
    rows = [(k, [f"own{k}", f"pair{k // 2}", *rng.sample(PLAIN, 9), *([forms[k // 4 % 26]] if k % 4 == 0 else [])]) for k in range(2600)]
    docs = spark.createDataFrame([(k, " ".join(rng.sample(t, len(t)))) for k, t in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(2600)], "doc_id long, toxic int")
    assert set(toxicity.learn(docs, labels, held_out=False).words) == set(forms)


def test_every_labelled_document_counts(spark):
    ids = spark.range(9_000).select(F.col("id").alias("doc_id"), F.row_number().over(Window.orderBy(F.xxhash64("id"), "id")).alias("nth"))
    words = F.when(F.col("nth") > 8_000, "zork").otherwise("fine")
    docs = ids.select("doc_id", "nth", F.concat_ws(" ", F.lit("we see"), words, F.concat(F.lit("n"), "doc_id")).alias("text")).cache()
    labels = docs.select("doc_id", (F.col("nth") > 8_000).cast("int").alias("toxic"))
    model = toxicity.learn(docs.select("doc_id", "text"), labels, held_out=False)
    assert model.words == ["zork"] and model.rates[1] > 1000 / 1003
