import random
import re

import pytest

from galley.errors import RulesetError
from galley.functions import numerals as N
from galley.functions import text as T
from galley.operators.predicates import PredicateError, predicate
from galley.plans import journal, ruleset

SPACES = "".join(c for c in map(chr, range(0x110000)) if c.isspace())


@pytest.fixture(scope="module")
def strings(spark):
    rng = random.Random(11)
    letters = "aBcÄßéЖǅ1٣ .:[]()*\n\t" + SPACES
    out = ["", "Title Case", "UPPER", "x:", "x: \n", "[1]", "(12)", "1*", "Table I.", None, *SPACES]
    out += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    return out, spark.createDataFrame(list(enumerate(out)), "i int, t string")


def got(df, column):
    return [r.v for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def test_text_functions_equal_python(strings):
    values, df = strings
    t = df["t"]
    has = [v for v in values]
    assert got(df, T.word_count(t)) == [None if v is None else len(v.split()) for v in has]
    assert got(df, T.strip(t)) == [None if v is None else v.strip() for v in has]
    assert got(df, T.non_blank(t)) == [bool(v and v.strip()) for v in has]
    assert got(df, T.is_title_case(t)) == [bool(v and v.istitle()) for v in has]
    assert got(df, T.is_upper_literal(t)) == [bool(v and re.search("[A-Za-z]", v) and v.upper() == v) for v in has]


@pytest.mark.parametrize("pattern", [r":\s*$", r"^\d+\*?$", r"^[\[\(]\d+[\]\)]$", r"\w+\b", r"[^\w\s]", r"(?P<a>[aB])(?P=a)", r"\S\Z", r"[[a]", r"\Bc", r"[\d.]+", r"[\s\S]a", r"[\W1]B"])
def test_patterns_equal_python(strings, pattern):
    values, df = strings
    assert got(df, T.matches(df["t"], pattern)) == [bool(v is not None and re.search(pattern, v)) for v in values]


def test_numerals(spark):
    df = spark.createDataFrame([(i, i) for i in range(1, 400)], "i int, n int").withColumn("r", N.int_to_roman(N.F.col("n")))
    assert got(df, N.roman_to_int(df["r"])) == list(range(1, 400)) and got(df, df["r"])[3:9] == ["IV", "V", "VI", "VII", "VIII", "IX"]
    odd = spark.createDataFrame(list(enumerate(["IIX", "x", "12", "", "Q", None])), "i int, t string")
    assert got(odd, N.roman_to_int(odd["t"])) == [8, 10, None, None, None, None]
    assert got(odd, N.numbering_style(odd["t"])) == ["roman", "roman", "arabic", "other", "other", None]


def test_predicates_on_null(spark):
    df = spark.createDataFrame([(0, None, None)], "i int, t string, n double")
    true = {"!=": 1.0, "not_in": [1.0]}
    for op, v in {"==": 1.0, "<": 1.0, ">=": 1.0, "in": [1.0], **true}.items():
        assert got(df, predicate(op, df["n"], v, "double")) == [op in true]
    for op, v, want in [("matches_regex", "a", False), ("not_matches_regex", "a", True), ("word_count_lte", 0, True), ("is_non_empty", None, False), ("in", "abc", False)]:
        assert got(df, predicate(op, df["t"], v, "string")) == [want]
    for op, v, kind in [("<", "a", "double"), ("is_title_case", None, "double"), ("like", 1, "int")]:
        with pytest.raises(PredicateError):
            predicate(op, df["n"], v, kind)


BROKEN = {
    "not JSON": "{",
    "rule r, condition.operator": '{"ruleset_id":"a","ruleset_version":"1","rules":[{"rule_id":"r","check_type":"deterministic","condition":{"attribute":"text","operator":"like","value":1}}]}',
    "auto_fixable needs": '{"ruleset_id":"a","ruleset_version":"1","rules":[{"rule_id":"r","check_type":"deterministic","auto_fixable":true,"condition":{"attribute":"text","operator":"==","value":1}}]}',
    "rule r, severty": '{"ruleset_id":"a","ruleset_version":"1","rules":[{"rule_id":"r","check_type":"deterministic","severty":"low","condition":{"attribute":"text","operator":"==","value":1}}]}',
    "applies_to_section": '{"ruleset_id":"a","ruleset_version":"1","rules":[{"rule_id":"r","check_type":"deterministic","applies_to_section":["intro"],"condition":{"attribute":"text","operator":"==","value":1}}]}',
    "needs a value": '{"ruleset_id":"a","ruleset_version":"1","rules":[{"rule_id":"r","check_type":"deterministic","condition":{"attribute":"text","operator":"=="}}]}',
    "used twice: r": '{"ruleset_id":"a","ruleset_version":"1","rules":[{"rule_id":"r","check_type":"semantic","prompt_template":"x"},{"rule_id":"r","check_type":"semantic","prompt_template":"x"}]}',
    "exactly one": '{"ruleset_id":"a","ruleset_version":"1","rules":[{"rule_id":"r","check_type":"semantic","prompt_template":"x","prompt_file":"y"}]}',
}


@pytest.mark.parametrize("message", BROKEN)
def test_broken_rulesets(message):
    with pytest.raises(RulesetError) as e:
        ruleset.parse(BROKEN[message])
    assert message in str(e.value)


def test_bundled_ruleset():
    rules = journal.bundled()
    assert len(rules.rules) == 40 and sum(r.auto_fixable for r in rules.rules) == 24 and len(rules.with_presence_rules().rules) == 50
    assert ruleset.parse(rules.model_dump_json()) == rules
    assert [r.rule_id for r in rules.ordered()][0] == "global-font" and rules.ordered()[-1].check_type == "semantic"


def test_words_are_counted_without_a_pattern(spark):
    texts = ["", " ", "a", " a  b ", "ä　 ß　", *(f"{c}a{c}{c}b c{c}" for c in map(chr, range(0x3001)) if c.isspace())]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert got(df, T.word_count(df["t"])) == [len(t.split()) for t in texts]
    assert "regexp" not in df.select(T.word_count(df["t"]))._jdf.queryExecution().optimizedPlan().toString()
