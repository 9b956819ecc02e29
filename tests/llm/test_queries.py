import pytest

from haplospark.llm import queries as Q
from tests.oracle import DATA, connect, differ

COLUMNS = {
    "op1_weak_supervision_pii": "doc_id bigint,n_email bigint,n_ip bigint,n_card bigint,n_phone bigint,base_sha256 string,spans string",
    "op2_best_fit_packing": "doc_id bigint,piece int,start bigint,length bigint,ids_crc32 bigint,sequence_id bigint,offset bigint",
    "op4_nn_descent": "query_id bigint,rank int,vec_id bigint,score double",
    "op6_suffix_array_dedup": "doc_id bigint,n_bytes bigint,n_removed bigint,n_spans bigint,kept_sha256 string",
    "op7_gru_language_id": "doc_id bigint,held_out boolean,lang_pred string,score double",
    "op8_minhash_near_dedup": "doc_id bigint,class_id bigint,kept boolean",
    "op9_quality_rules": "doc_id bigint,n_words bigint,word_chars bigint,n_symbols bigint,n_dup_lines bigint,n_repeat_words bigint,base_failed boolean,kept boolean",
    "op10_weak_supervision_toxicity": "doc_id bigint,held_out boolean,score double,predicted int",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    df = Q.queries()[name](spark, DATA)
    assert ",".join(f"{c} {t}" for c, t in df.dtypes) == COLUMNS[name]
    n = spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert df.count() >= (n if not name.startswith("op4") else 10)


def test_one_query_per_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in Q.queries()) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_equals_its_sql(spark, name):
    assert differ(Q.queries()[name](spark, DATA), Q.oracle_sql()[name], connect()) is None
