import pytest
from pyspark.sql import functions as F

from dendra.functions.text import force_list_citations
from dendra.operators.turns import converse_in_turns


class Model:
    """Each prompt's first line is its script; the number of lines since says which action comes."""

    def generate(self, prompts, max_tokens):
        out = []
        for p in prompts:
            script, _, rest = p.partition("\n")
            acts = script.split("|")
            at = sum(line.startswith(("Check", "Search", "Output: ", "Odd")) for line in rest.split("\n"))
            if acts[at] == "fail":
                raise RuntimeError("no model")
            out.append(acts[at].replace("SEEN", str(rest.count("Document ["))) + "\nrest")
        return out


def talk(spark, scripts, docs, **options):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(scripts)], "id long, prompt string")
    table = spark.createDataFrame(docs, "id long, doc int, title string, text string")
    return {r.id: r for r in converse_in_turns(rows, table, Model, **options).collect()}


DOCS = [(i, d, f"T{d}", t) for i in range(9) for d, t in enumerate(["red apples", "blue whales", "green trees"])]


def test_actions(spark):
    got = talk(spark, ["Output: a|Output: b.|End", "Check: [2][9][1]|SEEN shown|End.", "Odd", "I'm sorry, but no Relevant information", "None of the documents help", "Check [x]|none SEEN|end", "fail"], DOCS, max_turns=5)
    assert [got[i].output for i in range(7)] == [" a b.", " 2 shown", "", "", "", " none 0", ""]
    assert [got[i].ended for i in range(7)] == ["end", "end", "unknown", "abstain", "abstain", "end", "error"]
    assert [got[i].turns for i in range(7)] == [3, 3, 1, 1, 1, 3, 1]
    assert got[1].shown == [[1, 0]] and got[5].shown == [[]] and got[0].shown == []
    assert got[1].prompt.split("\n")[1:] == ["Check: [2][9][1]", "Output: 2 shown", "End.", ""]


def test_bounds(spark):
    endless = "|".join(["Check: [1][2][3]", "said"] * 4)
    got = talk(spark, [endless, endless], DOCS, max_turns=3, max_docs=2)
    assert got[0].ended == "turns" and got[0].turns == 3 and got[0].shown == [[0, 1], [0, 1]]
    got = talk(spark, [endless, "End"], DOCS, max_words=8)
    assert (got[0].ended, got[1].ended) == ("budget", "end")


def test_search_and_forced_citations(spark):
    got = talk(spark, ["Output: before [3].|Search: whales|It is [1] so. And so.|End", "Search: x|none|End", None], DOCS[:3], search=True, force="sentences", max_turns=5)
    assert got[0].shown == [[1]] and got[0].output == " before. [2] It is so. [2] And so.."
    assert got[1].shown == [[]] and got[1].output == "  none." and got[2].ended == "unknown"
    got = talk(spark, ["Check: [3][1]|a [1], b,|Output: c,|End"], DOCS, force="list", max_turns=5)
    assert got[0].output == " [3][1] a, [3][1] b,  [3][1] c"


def test_list_citations_and_odd_input(spark):
    row = spark.range(1).select(force_list_citations(F.lit("x [4], y "), F.array(F.lit(0), F.lit(2)))).first()[0]
    assert row == "[1][3] x, [1][3] y, "
    assert talk(spark, [], []) == {}
    with pytest.raises(ValueError):
        talk(spark, ["End"], [], force="words")
