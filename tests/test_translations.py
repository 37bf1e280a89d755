import math
import random

from compare import spark_bag, sql_bag, views

from stemma.operators import search as S
from stemma.plans import adapters as A
from stemma.plans import lookup as L

DOCS = "seq long, translation_id string, book string, text string, lemmas array<string>"


def test_each_translation_has_its_own_frequencies(spark):
    rng = random.Random(4)
    words = ["river", "stone", "lamp", "field", "gate", "bread"]
    docs = [(i, rng.choice(["en", "en", "en", "de", "und"]), f"b{i % 4}", " ".join(rng.choices(words, k=rng.randint(1, 9))), rng.choice([None, ["H7", "H7", "H8"], ["H9"]])) for i in range(120)]
    index = S.field_postings(spark.createDataFrame(docs, DOCS), "seq")
    got = {r["seq"]: (r["translation_id"], round(r["score"], 6)) for r in S.search_each(index, "seq", "river h7", prefix=False, fuzzy=0).collect()}
    want = {}
    for t in ("en", "de", "und"):
        mine = [d for d in docs if d[1] == t]
        for field, bags in (("text", [(d[0], d[3].split()) for d in mine]), ("lemmas", [(d[0], [x.lower() for x in d[4] or []]) for d in mine])):
            full = [b for b in bags if b[1]]
            mean = sum(len(b) for _, b in full) / len(full)
            for w in ("river", "h7"):
                df = sum(w in b for _, b in bags)
                for seq, b in full:
                    if tf := b.count(w):
                        part = math.log(1 + (len(mine) - df + 0.5) / (df + 0.5)) * (S.DELTA + tf * (S.K1 + 1) / (tf + S.K1 * (1 - S.B + S.B * len(b) / mean)))
                        want[seq] = (t, want.get(seq, (t, 0))[1] + part)
    assert {t for t, _ in want.values()} == {"en", "de", "und"}
    assert got == {k: (t, round(v, 6)) for k, (t, v) in want.items()}


def test_testament_before_the_limit(spark):
    scored = spark.createDataFrame([(i, f"b{i % 4}", float(-i)) for i in range(40)], "seq long, book string, score double")
    books = spark.createDataFrame([("b0", "OT"), ("b1", "OT"), ("b2", "NT")], "book string, testament string")
    assert [r["seq"] for r in S.top(S.in_testament(scored, books, "NT"), "seq", n=5).collect()] == [2, 6, 10, 14, 18]


def test_documents_without_an_index_score_alike(spark):
    rng = random.Random(5)
    words = ["shepherd", "shepherds", "sheperd", "shepherding", "h7", "field", "the", "gate"]
    docs = [(i % 110, rng.choice(["en", "de", "und"]), "b", rng.choice([None, "", "the"] + [" ".join(rng.choices(words, k=rng.randint(1, 9)))] * 9), rng.choice([None, [], ["H7", "H7", "H8"], ["H9"]])) for i in range(120)]
    df = spark.createDataFrame(docs, DOCS)
    rows = lambda found: sorted((r["translation_id"], r["seq"], round(r["score"], 6)) for r in found.collect())
    for q in ("shepherd h7", "gate", "the"):
        got = rows(S.search_docs(df, "seq", q))
        assert got == rows(S.search_each(S.field_postings(df, "seq"), "seq", q))
        assert bool(got) == (q != "the")


def indexes(words: list[str], reach: int) -> str:
    """SQL of s: translation_id, seq, score of every document for the words, over the fields text and lemmas."""
    found = " union all ".join(L._expansion(w, 0 if w[1].isdigit() else reach).replace("from df", "from (select distinct term, 0 df from idx)") for w in words)
    return rf"""with {A.VERSES}, fields as (
  select translation_id, seq, 'text' field, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\pL\pN]+'), lambda w: w <> '' and w not in {L._STOP}) t from verses
  union all select translation_id, seq, 'lemmas', list_distinct(list_transform(list_filter(string_split_regex(text, '[^A-Za-z]+'), lambda w: length(w) >= 5), lambda w: 'h' || (ascii(lower(w)) * 10 + length(w) % 10))) from verses where translation_id = 'en' and text is not null),
idx as (select translation_id, seq, field, term, length, count(*) tf from (select translation_id, seq, field, len(t) length, unnest(t) term from fields) group by all),
docs as (select translation_id, count(distinct seq) n from idx group by 1), means as (select translation_id, field, avg(l) mean from (select translation_id, field, seq, max(length) l from idx group by all) group by all),
dfs as (select translation_id, field, term, count(*) df from idx group by all), e as ({found}),
s as (select translation_id, seq, sum({L._BM}) score from idx join (select term, weight from e where weight is not null) using (term) join dfs using (translation_id, field, term) join means using (translation_id, field) join docs using (translation_id) group by all)"""


def test_fulltext_translations_beside_sql(spark, sf_dir):
    got = spark_bag(L.fulltext_translations(spark, sf_dir))
    assert got == sql_bag(views(sf_dir), f"{indexes(['shepherd', 'h01196'], 2)} select translation_id, seq, round(score, 6) score from s")
    assert got[1]


def test_testament_search_beside_sql(spark, sf_dir):
    got = spark_bag(L.testament_search(spark, sf_dir))
    assert got == sql_bag(views(sf_dir), f"""{indexes(['distant', 'promise'], 0)}, {A.BOOK_ORDER}, half as (select book from book_order where ord * 2 >= (select count(*) from book_order))
select translation_id, seq, book, round(score + case when contains(lower(text), 'distant promise') then 50 when contains(lower(text), 'distant') and contains(lower(text), 'promise') then 15 else 0 end, 6) score
from s join verses using (translation_id, seq) semi join half using (book) order by 4 desc, 2 limit 50""")
    assert got[1]


def test_testament_search_where_translations_share_numbers(spark, tmp_path):
    """A number is a document of its own in each translation; of equal scores the translation's name decides which are among the 50."""
    docs = [(i, t, f"{'b3' if t == 'de' and i % 2 else f'b{i % 4}'}.1.1", text, "s", "k", None) for i in range(60) for t, text in (("fr", "a distant promise"), ("en", "distant gate"), ("de", "a distant promise"), ("el", "gate" if i % 3 else "promise distant"))]
    spark.createDataFrame(docs, "doc_id long, lang string, osis_ref string, text string, source string, doc_kind string, written_at timestamp").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(f"b{i}", 1, 9) for i in range(4)], "book string, chapter int, verses int").write.parquet(f"{tmp_path}/ref_counts.parquet")
    got = spark_bag(L.testament_search(spark, str(tmp_path)))
    assert got == sql_bag(views(str(tmp_path)), f"""{indexes(['distant', 'promise'], 0)}, {A.BOOK_ORDER}, half as (select book from book_order where ord * 2 >= (select count(*) from book_order))
select translation_id, seq, book, round(score + case when contains(lower(text), 'distant promise') then 50 when contains(lower(text), 'distant') and contains(lower(text), 'promise') then 15 else 0 end, 6) score
from s join verses using (translation_id, seq) semi join half using (book) order by 4 desc, 2, 1, 3 limit 50""")
    assert sum(got[1].values()) == 50
