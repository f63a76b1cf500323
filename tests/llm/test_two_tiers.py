from tokenizers import Tokenizer

from wirescore.llm import token_counts
from wirescore.llm.common import tokenizer_path


def test_table_holds_what_is_frequent_with_true_lengths(spark):
    path = tokenizer_path("byte_bpe_50k.json")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = [r["text"] for r in docs.select("text").collect()]
    table = token_counts.frequent_lengths(path, texts[:500], 20_000)
    library = Tokenizer.from_file(path)
    words = list(table)[:300]
    assert len(table) == 20_000 and [table[w] for w in words] == [len(library.encode(w, add_special_tokens=False).ids) for w in words]
    assert max(table.values()) > 1
    rest = [w for t in texts[500:] if not token_counts.UNSAFE.search(t) for w in token_counts.PRE_TOKENS.findall(t)]
    plain = token_counts.frequent_lengths(path, (), 20_000)
    hits, before = sum(w in table for w in rest) / len(rest), sum(w in plain for w in rest) / len(rest)
    print(f"\nhit rate {hits:.3f}, of the vocabulary alone {before:.3f}")
    assert hits > before
    rows = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs, sample_rows=20).collect()}
    assert rows == {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs).collect()}
