from palimpsest.llm.lookalikes import fold, one_form, same_print


def forms(spark, texts):
    return {r.stored: r.form for r in one_form(spark.createDataFrame([(t,) for t in texts], "t string"), "t").collect()}


def test_fold():
    assert fold("ｆｕｌｌ　ｗｉｄｔｈ：") == "full width:" and fold("cö​p­") == "cöp" and fold("a b c‐d") == "a b c-d" and fold("ﬁeld ⾦") == "field 金"
    assert fold("x² … ½") == "x² … ½"


def test_repairs(spark):
    plain = "Sparse fuel cells at 300 K and a loss"
    got = forms(spark, [plain, "Ѕраrѕе fuеl сеllѕ аt 300 К аnd а lоѕѕ", "kΩ and μm", "Русский заголовок", "ѕоmеthіng еlѕе", "", None, plain])
    assert got["Ѕраrѕе fuеl сеllѕ аt 300 К аnd а lоѕѕ"] == plain and got["kΩ and μm"] == "kΩ and μm" and got["Русский заголовок"] == "Русский заголовок"
    assert got["ѕоmеthіng еlѕе"] == "ѕоmеthіng еlѕе" and got[""] == "" and len(got) == 6  # no word of the corpus


def test_pairs(spark):
    rows = [("b", "Fuel cell"), ("a", "Fuеl cell"), ("a", "Fuеl cell"), ("c", "fuel cell"), ("d", "Fuel cell"), ("e", None), (None, "Fuel cell"), ("f", "Fuel  cell"), ("g", "Fuel cell")]
    df = spark.createDataFrame(rows, "id string, t string").selectExpr("*", "1 AS k", "'x' AS form", "'y' AS stored")
    assert {tuple(r) for r in same_print(df, "id", "t").collect()} == {("a", "b"), ("a", "d"), ("b", "d"), ("a", "g"), ("d", "g")}
    assert same_print(spark.createDataFrame([], "id string, t string"), "id", "t").count() == 0


def test_long_text(spark):
    long = "wоrd " * 20000 + "word"
    assert forms(spark, [long])[long] == "word " * 20000 + "word"
