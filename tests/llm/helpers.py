from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, sources=None, ids=None):
    """A documents table out of texts."""
    rows = [(i if ids is None else ids[i], t, "en", None if sources is None else sources[i], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


#: Columns that a careless operator would trip over.
CLASHING = ("mark", "size", "rank", "block", "h", "fp", "component", "clean", "quality", "leaks", "score", "host", "words", "_id", "_mark", "_gone", "tw_in_0", "Text2")


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHING})


def prose(rng, n, words=("alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta", "zeta", "eta", "iota", "mu", "nu", "xi", "pi", "rho")):
    return " ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(n))
