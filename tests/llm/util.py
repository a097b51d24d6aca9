"""Small tables for the operators' edge cases."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, row string, words string"
FULL = ["doc_id", "text", "lang", "source", "n_chars"]


def docs(spark, texts, ids=None):
    """Documents with extra columns whose names the operators use themselves."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, None, "s", None if t is None else len(t), 7, "r", None) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, DOCS)


def sample(spark, sf="sf0.001"):
    return spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")


def texts_of(df):
    return {r.doc_id: r.text for r in df.collect()}


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
