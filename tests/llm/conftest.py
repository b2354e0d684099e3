import pandas as pd
import pytest

EXTRA = {"n_words": 7, "kept": "x", "row": 1, "items": "i", "length": 2, "score": 0.5, "root": 3, "near": "n", "_t": "t", "N_HIT": 1, "n_lines": 4, "file": "f", "a": 1, "b": 2}
LONG = " ".join(f"long{i % 977} word{i}" for i in range(30_000))
SHARED = " ".join(f"shared{i}" for i in range(40))


def edge_documents() -> pd.DataFrame:
    """Nulls in every column, empty, blank, short, very long and repeated texts, ties, and columns with clashing names."""
    texts = [
        None, "", "  \n\t ", "one", "a b c d", "a b c d", LONG, LONG + " tail", SHARED, "before " + SHARED + " after", SHARED, "x\x1cy z é É ß",
        "the same line\nthe same line\nother", "it's <|endoftext|> we'll  \n\n go", "word " * 300, "#*$% &|<> #", "\n\n\n", "same " * 9, "idiot you " * 30,
    ]
    out = pd.DataFrame({"doc_id": range(10_000, 10_000 + len(texts)), "text": texts, "lang": "en", "source": "s1", "n_chars": [len(t or "") for t in texts]})
    out = out.astype({"n_chars": "Int64"})
    out.loc[3, ["lang", "source", "n_chars"]] = None
    return out.assign(**EXTRA)


def spark_documents(spark, pdf: pd.DataFrame):
    kinds = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long", "item_id": "long", "quality": "int", "toxic": "int", "page_id": "long", "url": "string", "html": "string"}
    schema = ", ".join(f"`{c}` {kinds.get(c) or ('string' if isinstance(EXTRA.get(c), str) else 'double' if c == 'score' else 'int')}" for c in pdf.columns)
    whole = [kind.split()[-1] in ("long", "int") for kind in schema.split(", ")]
    rows = [tuple(None if pd.isna(v) else int(v) if w else v.item() if hasattr(v, "item") else v for v, w in zip(r, whole)) for r in pdf.itertuples(index=False, name=None)]
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def corpus(small):
    return pd.concat([pd.read_parquet(f"{small}/documents.parquet"), edge_documents()[["doc_id", "text", "lang", "source", "n_chars"]]], ignore_index=True)


@pytest.fixture(scope="session")
def edge_dir(spark, small, tmp_path_factory):
    """The small tables, with the edge rows among the documents and edge pages, benchmark items and labels."""
    d = tmp_path_factory.mktemp("edge")
    docs = pd.concat([pd.read_parquet(f"{small}/documents.parquet"), edge_documents()], ignore_index=True)
    docs = docs[["doc_id", "text", "lang", "source", "n_chars", *EXTRA]]
    spark_documents(spark, docs.astype(object).where(docs.notna(), None)).write.parquet(f"{d}/documents.parquet")
    pages = pd.read_parquet(f"{small}/pages.parquet")
    more = pd.DataFrame({"page_id": [9001, 9002, 9003, 9004, 9005], "url": [None, "http://x\n", "u", "", "v"], "html": [None, "", pages.html[0], "é", pages.html[0]]})
    spark_documents(spark, pd.concat([pages, more], ignore_index=True)).write.parquet(f"{d}/pages.parquet")
    items = pd.read_parquet(f"{small}/benchmark.parquet")
    more = pd.DataFrame({"item_id": [901, 902, 903, 904, 905, 906], "text": [None, "", "!!", "A b C", SHARED, SHARED]})
    spark_documents(spark, pd.concat([items, more], ignore_index=True)).write.parquet(f"{d}/benchmark.parquet")
    labels = pd.read_parquet(f"{small}/labels.parquet")
    more = pd.DataFrame({"doc_id": [10_000, 10_018, 10_005], "quality": [None, 1, 0], "toxic": [None, 1, 0]})
    both = pd.concat([labels, more], ignore_index=True).astype(object)
    spark_documents(spark, both.where(both.notna(), None)).write.parquet(f"{d}/labels.parquet")
    spark.read.parquet(f"{small}/embeddings.parquet").write.parquet(f"{d}/embeddings.parquet")
    return str(d)


@pytest.fixture(scope="session")
def empty_dir(spark, edge_dir, tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
        spark.read.parquet(f"{edge_dir}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    return str(d)
