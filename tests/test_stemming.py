"""English stems, and the lexical list that uses them."""

from dossierspark.functions.stemming import stem_of
from dossierspark.operators.retrieval import lexical_list


def test_stems():
    want = """supported:support integrations:integr integration:integr consistency:consist knightly:knight generously:generous hopping:hop
    hoping:hope skies:sky ties:tie cries:cri gas:gas gaps:gap happy:happi relational:relat vietnamization:vietnam agreed:agre feed:feed
    communication:communic youth:youth boy:boy controlling:control roll:roll sensibly:sensibl succeed:succeed add:add bed:bed 27001:27001"""
    for pair in want.split():
        word, stem = pair.split(":")
        assert stem_of(word) == stem, word


def test_lexical_list_finds_other_inflections(spark):
    items = [(1, "Integrations are", "supported by the vendor"), (2, None, "the the the of of and our what is"), (3, "", "nothing here")]
    items = spark.createDataFrame(items, "item_id long, question string, answer string")
    queries = spark.createDataFrame([(1, "What is the support of our integration?"), (2, "the of and"), (3, None)], "query_id long, text string")
    got = lexical_list(items, queries).collect()
    assert [(r["query_id"], r["item_id"], r["n_terms"]) for r in got] == [(1, 1, 2)]
    assert abs(got[0]["score"] - 1.4 / 1.3862943611198906) < 1e-12  # three positions: integr, support, vendor
    assert lexical_list(items, queries, stem=False).where("item_id = 2").count() == 2  # stop words count there
