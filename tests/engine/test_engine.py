"""Micro fixtures for the pattern language, the readers and the measures."""

import gzip
from itertools import islice

import pytest
from pyspark.sql import functions as F

from lexarbor.functions.tags import decode_msd, split_msd, translate_msd
from lexarbor.operators.collocations import collocation_key, lowercase_forms
from lexarbor.operators.matcher import match_structure
from lexarbor.operators.prefix import sums_before
from lexarbor.operators.wordfeats import common_features, common_tag
from lexarbor.plans.report import Analysis, Config
from lexarbor.plans.structures import parse_catalogue
from lexarbor.queries import EDGE, TOP, catalogue, morph, pattern, structure, sz_kh_words
from lexarbor.sources.corpus import read_conllu, read_corpus, read_tei, tei_sentences
from lexarbor.sources.lexicon import build_lexicon, find_forms, find_lemma_tags
from lexarbor.sources.sinks import as_text, write_map, write_report, write_tei

CONLLU = """# sent_id = s1
1\tVelika\tvelik\tADJ\tAgpfsn\tCase=Nom|Gender=Fem\t2\tamod\t_\t_
2\thiša\thiša\tNOUN\tNcfsn\tCase=Nom|Gender=Fem\t3\tnsubj\t_\t_
3\tstoji\tstati\tVERB\tVmpr3s\t_\t0\troot\t_\tSpaceAfter=No
4-5\tvgori\t_\t_\t_\t_\t_\t_\t_\t_
4\tv\tv\tADP\tSl\t_\t5\tcase\t_\t_
5\tgori\tgora\tNOUN\tNcfsl\tCase=Loc|Gender=Fem\t3\tobl\t_\t_

# sent_id = s1
1\tMala\tmali\tADJ\tAgpfsn\tCase=Nom|Gender=Fem\t2\tamod\t_\t_
2\thiša\thiša\tNOUN\tNcfsn\tCase=Nom|Gender=Fem\t0\troot\t_\t_

"""
TEI = b"""<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><p><s xml:id="d.1"><w xml:id="d.1.t1" lemma="velik" msd="UPosTag=ADJ|Case=Nom" join="right">Velika</w><pc xml:id="d.1.t2" msd="UPosTag=PUNCT">,</pc><w xml:id="d.1.t3" lemma="hisa" msd="UPosTag=NOUN">hisa</w>
<linkGrp><link ana="ud-syn:amod" target="#d.1.t3 #d.1.t1"/><link ana="jos-syn:x" target="#d.1.t3 #d.1.t1"/><link ana="ud-syn:root" target="#d.1 #d.1.t3"/></linkGrp></s></p></text></TEI>"""


def lemmas(corpus, xml, *cids):
    found = match_structure(corpus, parse_catalogue(xml, statistics=False).structures[0])
    return sorted(tuple(r) for r in found.select(*(F.try_element_at("words", F.lit(c))["lemma"] for c in cids)).collect())


def corpus(spark, tmp_path):
    (tmp_path / "a.conllu").write_text(CONLLU)
    return read_conllu(spark, str(tmp_path / "a.conllu"))


def test_conllu(spark, tmp_path):
    c = corpus(spark, tmp_path)
    rows = c.tokens.orderBy("sent_ix", "tok").collect()
    assert [r["form"] for r in rows] == ["", "Velika", "hiša", "stoji", "v", "gori", "", "Mala", "hiša"]
    assert rows[1]["msd"] == "Case=Nom|Gender=Fem|POS=ADJ" and rows[3]["glue"] and rows[3]["msd"] == "POS=VERB"
    assert c.edges.count() == 7


def test_children(spark, tmp_path):
    c = corpus(spark, tmp_path)
    assert lemmas(c, pattern(TOP, "1 2 amod"), "1", "2") == [("hiša", "mali"), ("hiša", "velik")]
    assert lemmas(c, pattern(TOP, "1 2 nsubj|obl", "2 3 case", status={"3": "forbidden"}), "1", "2") == [("stati", "hiša")]
    assert lemmas(c, pattern(TOP, "1 2 nsubj|obl", "2 3 case", status={"3": "optional"}), "2", "3") == [("gora", "v"), ("hiša", None)]
    assert lemmas(c, pattern(TOP, "1 2 amod to-from", restrict={"1": morph(POS="NOUN")}), "2") == [("mali",), ("velik",)]
    assert lemmas(c, pattern(TOP, "1 2 amod from-to"), "2") == []
    assert lemmas(c, pattern(TOP, "1 2 nsubj", "1 3 nsubj"), "2", "3") == []


def test_modra_matches_the_root(spark, tmp_path):
    c = corpus(spark, tmp_path)
    c = type(c)(c.sentences.withColumn("links", F.transform("links", lambda x: x.withField("label", F.when(x["label"] == "root", "modra").otherwise(x["label"])))))
    assert lemmas(c, pattern("# 1 modra", "1 2 amod"), "#", "1", "2") == [("", "hiša", "mali")]


def test_tei(spark, tmp_path):
    (tmp_path / "a.xml").write_bytes(TEI)
    c = read_tei(spark, str(tmp_path / "a.xml"))
    rows = c.tokens.orderBy("tok").collect()
    assert [(r["lemma"], r["pos"], r["glue"], r["previous_glue"], r["int_id"]) for r in rows[1:]] == [("velik", "ADJ", True, False, 1), (",", "PUNCT", False, True, 2), ("hisa", "NOUN", False, False, 3)]
    assert lemmas(c, pattern(TOP, "1 2 amod"), "1", "2") == [("hisa", "velik")]


def test_report_map_and_sinks(spark, tmp_path):
    a = Analysis(corpus(spark, tmp_path), parse_catalogue(pattern(TOP, "1 2 amod", show={"2": '<feature rendition="word_form"/><feature selection="agreement" msd="case+gender" head_cid="1"/>', "1": '<feature rendition="word_form"/>'})), Config(lang="sl"))
    rows = a.report.collect()
    assert [(r["Collocation_ID"], r["C1_Representative_form"], r["C2_Representative_form"], r["Frequency"]) for r in rows] == [(1, "hiša", "Velika", 1), (2, "hiša", "Mala", 1)]
    assert rows[0]["LogDice_core"] is not None and a.sentence_map.collect()[0]["Token_ids"] == "s1.2|s1.1"
    write_report(a.report, str(tmp_path / "out"), decimal=",")
    write_map(a.sentence_map, str(tmp_path / "map"))
    assert spark.read.text(str(tmp_path / "out")).count() == 3


def test_forms_selection(spark, tmp_path):
    show = {"2": '<feature rendition="word_form"/><feature selection="msd" Case="Nom"/>', "1": '<feature rendition="word_form"/><feature selection="msd" Case="Gen"/>'}
    a = Analysis(corpus(spark, tmp_path), parse_catalogue(pattern(TOP, "1 2 amod", show=show)))
    row = a.report.first()
    assert (row["C1_RF_scenario"], row["C1_Representative_form"], row["C2_RF_scenario"], row["C2_Representative_form"]) == ("lemma_fallback", "hiša", "ok", "Velika")


def test_small_functions(spark):
    df = spark.createDataFrame([("Ncfsn", ["Ncfsn", "Ncmsn"], [{"a": "1", "b": "2"}, {"a": "1"}])], "m string, t array<string>, f array<map<string,string>>")
    row = df.select(decode_msd(F.col("m")).alias("d"), common_tag(F.col("t")).alias("t"), common_features(F.col("f")).alias("f")).first()
    assert row["d"]["gender"] == "feminine" and row["t"] == "Nc-sn" and row["f"] == {"a": "1"}
    words = spark.createDataFrame([("x", "m", "N", "Ab", 10), ("x", "m", "N", "ab", 1), ("y", "m", "N", "Cd", 30), ("y", "m", "N", "cd", 1)], "lemma string, msd string, pos string, text string, frequency long")
    assert sorted((r["lemma"], r["text"]) for r in lowercase_forms(words).collect()) == [("x", "ab"), ("x", "ab"), ("y", "Cd"), ("y", "cd")]
    keys = spark.sql("SELECT map('1', named_struct('lemma', 's'), '2', named_struct('lemma', 'gora')) AS w").select(collocation_key(F.col("w")).alias("k")).first()
    assert keys["k"][0]["lemma"] == "z"


def test_sz_kh_of_whole_texts(spark, tmp_path):
    spark.createDataFrame([(1, "Gora hiša.\nmesto"), (2, "a b Kava gora"), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["lemma"], r["p"]): (r["settled"], r["frequency"]) for r in sz_kh_words(spark, str(tmp_path)).collect()}
    words = {"gora": ("z", "h", 2), "hiša": ("s", "k", 1), "mesto": ("z", "k", 1), "a": ("z", "k", 1), "b": ("z", "k", 1), "kava": ("s", "h", 1)}
    assert got == {(w, p): (sz if p in "sz" else kh, n) for w, (sz, kh, n) in words.items() for p in "szkh"}


def test_native_tags(spark, tmp_path):
    pairs = {"Somei": "Ncmsn", "Sometd": "Ncmsay", "Ggdd-em": "Vmep-sm", "Gp-spe-d": "Va-r1s-y", "Ggdm": "Vmeu", "Gp-g": "Va-c", "Ppnmeid": "Agpmsny", "Pdnmein": "Appmsnn", "Rsr": "Rgc", "Zspmedd": "Ps1msdd", "Zp---d--k": "Px---d--y", "Zp---t--z": "Px---a--b", "Kag": "Mdc", "Kbvmei": "Mlomsn", "Dt": "Sa", "Vd": "Cs", "L": "Q", "M": "I", "O": "Y", "N": "X", "Nj": "Xf", "U": "Z", "": "", "?x": "?x"}
    df = spark.createDataFrame([*pairs.items(), (None, None)], "native string, msd string")
    assert df.where(~translate_msd(F.col("native")).eqNullSafe(F.col("msd"))).count() == 0
    row = df.where("native = 'Ggdd-em'").select(split_msd(F.col("msd")).alias("x")).first()["x"]
    assert (row["lexeme"], row["form"]) == ({"pos": "verb", "type": "main", "aspect": "perfective"}, {"vform": "participle", "number": "singular", "gender": "masculine"})
    row = spark.sql("SELECT '?x' AS m").select(split_msd(F.col("m")).alias("x")).first()["x"]
    assert (row["lexeme"], row["form"]) == ({}, {})
    (tmp_path / "a.xml").write_bytes(TEI.replace(b'msd="UPosTag=ADJ|Case=Nom"', b'ana="mte:Ppnzei"').replace(b'msd="UPosTag=PUNCT"', b'ana="mte:U"').replace(b'msd="UPosTag=NOUN"', b'ana="mte:Sozei"'))
    c = read_tei(spark, str(tmp_path / "a.xml"), ud=False, jos_tags="sl")
    assert [(r["pos"], r["msd"]) for r in c.tokens.orderBy("tok").collect()[1:]] == [("A", "Agpfsn"), ("Z", "Z"), ("N", "Ncfsn")]


def test_a_store_is_resumed(spark, tmp_path):
    c, xml, store = corpus(spark, tmp_path), parse_catalogue(pattern(TOP, "1 2 amod")), str(tmp_path / "store")
    first = [tuple(r) for r in Analysis(c, xml, store=store).report.collect()]
    (tmp_path / "store" / "collocations" / "_SUCCESS").unlink()  # as a run that was cut off leaves it
    stamp = (tmp_path / "store" / "matches" / "_SUCCESS").stat().st_mtime_ns
    assert [tuple(r) for r in Analysis(c, xml, store=store).report.collect()] == first == [tuple(r) for r in Analysis(c, xml).report.collect()]
    assert (tmp_path / "store" / "matches" / "_SUCCESS").stat().st_mtime_ns == stamp and (tmp_path / "store" / "collocations" / "_SUCCESS").exists()


def test_sums_before_over_ranges(spark):
    rows = spark.range(1000).select(F.when(F.col("id") > 3, F.col("id") * 7919 % 1009).alias("k"), F.col("id").alias("v"), F.lit("x").alias("__before"))
    order = [F.col("k").desc_nulls_last(), F.col("v")]
    got = {r["v"]: (r["before"], r["n"]) for r in sums_before(rows, order, {"before": F.col("v"), "n": F.lit(1)}).collect()}
    total, want = 0, {}
    for i, (_, v) in enumerate(sorted(((-(v * 7919 % 1009) if v > 3 else 1, v) for v in range(1000)))):
        want[v], total = (total, i), total + v
    assert got == want
    assert sums_before(rows.limit(0), order, {"n": F.lit(1)}).count() == 0


def test_lexicon(spark):
    forms = spark.createDataFrame([("a", "Ncfsn", "a", 3), ("a", "Ncfsn", "b", 5), ("a", "Ncmsn", "c", 1)], "lemma string, msd string, form string, frequency long")
    lexicon = build_lexicon(forms)
    assert sorted((r["msd"], r["form"]) for r in lexicon.collect()) == [("Ncfsn", "a"), ("Ncfsn", "b"), ("Ncmsn", "c")]
    asked = spark.createDataFrame([("a", {"gender": "masculine"}), ("z", {})], "lemma string, need map<string,string>")
    assert sorted((r["lemma"], r["form"]) for r in find_forms(asked, lexicon).collect()) == [("a", "c"), ("z", None)]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_patterns_are_matched_without_a_shuffle_or_join(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    from lexarbor.operators.matcher import match_catalogue
    from lexarbor.sources.corpus import documents_corpus

    xml = catalogue(structure(TOP, "1 2 obj|obl|nsubj", "2 3 amod", "2 4 case", name="x"), structure(TOP, "1 2 amod", "1 3 case", name="y", status={"3": "forbidden"}))
    plan = plan_of(match_catalogue(documents_corpus(docs), parse_catalogue(xml, statistics=False)))
    assert "Exchange" not in plan and "Join" not in plan and plan.count("Scan") == 1


def test_absent_optional_leaves_its_siblings(spark, tmp_path):
    xml = pattern(TOP, "1 2 nsubj", "1 3 iobj", "1 4 obl", status={"3": "optional"})
    assert lemmas(corpus(spark, tmp_path), xml, "1", "2", "3", "4") == [("stati", "hiša", None, "gora")]


def test_crlf_and_odd_names(spark, tmp_path):
    folder = tmp_path / "a b" / "c+d"
    folder.mkdir(parents=True)
    (folder / "x y.conllu").write_bytes(CONLLU.replace("\n", "\r\n").encode())
    c = read_corpus(spark, str(tmp_path / "a b"))
    assert c.sentences.count() == 2 and [r["form"] for r in c.tokens.where("NOT is_root").orderBy("sent_ix", "tok").collect()][-2:] == ["Mala", "hiša"]
    assert {r["sentence_id"] for r in c.sentences.collect()} == {"s1"}


def test_directories_of_both_formats(spark, tmp_path):
    (tmp_path / "b.conllu").write_text(CONLLU)
    (tmp_path / "a.xml").write_bytes(TEI)
    (tmp_path / "c.conllup").write_text("# global.columns = ID FORM LEMMA UPOS XPOS FEATS HEAD DEPREL DEPS MISC NER\n" + CONLLU.replace("\t_\n", "\t_\tO\n"))
    (tmp_path / "d.conllu.zstd").write_bytes(b"x")
    c = read_corpus(spark, str(tmp_path))
    assert [(r["file_ix"], r["n"]) for r in c.sentences.groupBy("file_ix").agg(F.count("*").alias("n")).orderBy("file_ix").collect()] == [(0, 1), (1, 2), (2, 2)]
    found = match_structure(c, parse_catalogue(EDGE, statistics=False).structures[0])
    assert found.count() == 5
    (tmp_path / "e.doc").write_text("x")
    with pytest.raises(ValueError, match="unknown corpus format"):
        read_corpus(spark, str(tmp_path))


def test_a_file_split_over_tasks_keeps_its_order(spark, tmp_path):
    text = "".join(f"# sent_id = s{i}\n1\tw{i}\tw{i}\tNOUN\t_\t_\t0\troot\t_\t_\n\n" for i in range(500))
    (tmp_path / "a.conllu").write_text(text)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        c = read_conllu(spark, str(tmp_path / "a.conllu"))
        assert c.sentences.rdd.getNumPartitions() > 5
        assert [r["sentence_id"] for r in c.sentences.orderBy("file_ix", "sent_ix").collect()] == [f"s{i}" for i in range(500)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


JOS_CONLLU = """# sent_id = j1
1\tlepa\tlep\tADJ\tAgpfsn\t_\t2\tAtr\t_\t_
2\thiša\thiša\tNOUN\tNcfsn\t_\t0\tRoot\t_\t_
3\t.\t.\tPUNCT\tZ\t_\t0\tRoot\t_\t_

# sent_id = j2
1\tlepi\tlep\tADJ\tAgpmsn\t_\t2\tAtr\t_\t_
2\thiši\thiša\tNOUN\tNcfsl\t_\t0\tRoot\t_\t_

"""


def test_positional_system_end_to_end(spark, tmp_path):
    (tmp_path / "j.conllu").write_text(JOS_CONLLU)
    c = read_conllu(spark, str(tmp_path / "j.conllu"), ud=False, jos_labels="en")
    assert c.edges.where("dep.msd = 'Z'").select("label").first()[0] == "modra"
    noun, adjective = '<restriction type="morphology"><feature POS="noun"/><feature case="locative" filter="negative"/></restriction>', morph(POS="adjective", degree="positive")
    assert lemmas(c, pattern(TOP, "1 2 dol", system="JOS", restrict={"1": noun, "2": adjective}), "1", "2") == [("hiša", "lep")]
    show = {"1": '<feature rendition="word_form"/><feature selection="msd" case="genitive"/>', "2": '<feature rendition="lemma"/>'}
    xml = parse_catalogue(pattern(TOP, "1 2 dol", system="JOS", restrict={"1": morph(POS="noun"), "2": adjective}, show=show))
    plain = Analysis(c, xml).report.first()
    assert (plain["C1_RF_scenario"], plain["C1_Representative_form"], plain["C2_RF_msd"], plain["Frequency"]) == ("lemma_fallback", "hiša", "Agpfsn", 2)
    forms = spark.createDataFrame([("hiša", "Ncfsg", "hiše", 5), ("hiša", "Ncfsn", "hiša", 9), ("lep", "Agpmsn", "lep", 3)], "lemma string, msd string, form string, frequency long")
    row = Analysis(c, xml, lexicon=build_lexicon(forms)).report.first()
    assert (row["C1_RF_scenario"], row["C1_Representative_form"], row["C1_RF_msd"], row["C2_RF_msd"]) == ("ok", "hiše", "Ncfsg", "Agpmsn")


def test_what_agrees_with_the_common_features_is_shown(spark, tmp_path):
    """No tag of the head has a fitting adjective; what its tags share (the gender) has one."""
    (tmp_path / "j.conllu").write_text(JOS_CONLLU.replace("Agpmsn", "Agpfpg").replace("Agpfsn", "Agpfdd"))
    c = read_conllu(spark, str(tmp_path / "j.conllu"), ud=False, jos_labels="en")
    show = {"1": '<feature rendition="word_form"/><feature selection="msd" case="dative"/>', "2": '<feature rendition="word_form"/><feature selection="agreement" msd="gender" head_cid="1"/>'}
    row = Analysis(c, parse_catalogue(pattern(TOP, "1 2 dol", system="JOS", restrict={"1": morph(POS="noun"), "2": morph(POS="adjective")}, show=show))).report.first()
    assert (row["C1_RF_scenario"], row["C2_RF_scenario"], row["C2_Representative_form"]) == ("lemma_fallback", "ok", "lepa")


def test_numbers_are_rounded_as_exact_binary_values(spark):
    numbers = [0.015625, 0.046875, 0.000025, 2.5, -0.000005, None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double").orderBy("i")
    assert [r[0] for r in df.select(as_text(df, ",")[1]).collect()] == ["" if x is None else ("%.5f" % x).replace(".", ",") for x in numbers]


def test_a_file_for_each_structure(spark, tmp_path):
    a = Analysis(corpus(spark, tmp_path), parse_catalogue(catalogue(structure(TOP, "1 2 amod", name="x"), structure(TOP, "1 2 nsubj", name="y"))))
    write_report(a.report, str(tmp_path / "out"), per_structure=True)
    write_map(a.map_rows(by_structure=True), str(tmp_path / "map"))
    for name, n in (("x", 2), ("y", 1)):
        files = list((tmp_path / "out" / f"structure={name}").glob("*.txt"))
        lines = files[0].read_text().splitlines()
        assert len(files) == 1 and len(lines) == n + 1 and lines[0].startswith("Structure_ID\t") and all(x.startswith(f"{name}\t") for x in lines[1:])
        said = "".join(f.read_text() for f in (tmp_path / "map" / f"Structure_ID={name}").glob("*.csv")).splitlines()
        assert len(said) == n + 1 and said[0] == "Collocation_id\tSentence_id\tToken_ids"


def test_report_is_sorted_by_a_column(spark, tmp_path):
    xml = parse_catalogue(pattern(TOP, "1 2 amod"))
    names = [r["C2_Lemma"] for r in Analysis(corpus(spark, tmp_path), xml, Config(sort_by=6)).report.collect()]
    back = [r["C2_Lemma"] for r in Analysis(corpus(spark, tmp_path), xml, Config(sort_by=6, sort_reversed=True)).report.collect()]
    assert (names, back) == (["mali", "velik"], ["velik", "mali"])


def test_lexicon_repairs_and_lemma_tags(spark):
    forms = spark.createDataFrame([("a", "Rdn", "a", 1), ("a", "Rd", "b", 4), ("z", "Ncmsg", "zx", 2)], "lemma string, msd string, form string, frequency long")
    lexicon = build_lexicon(forms)
    assert {r["msd"] for r in lexicon.collect()} == {"Rd", "Ncmsg"}
    asked = spark.createDataFrame([("a", {"case": "dative"}), ("z", {"case": "dative"}), ("y", {})], "lemma string, need map<string,string>")
    assert sorted(r["lemma_msd"] or "" for r in find_lemma_tags(asked, lexicon).collect()) == ["", "Ncmsg", "Rd"]
    assert sorted((r["lemma"], r["form"]) for r in find_forms(asked, lexicon, last_resort=True).collect()) == [("a", "a"), ("y", None), ("z", "zx")]


def test_new_documents_are_counted_once(spark, tmp_path):
    from lexarbor.streaming.ingest import count_new_documents, total_counts

    schema = "doc_id long, text string"
    for text in ("aa bb", "aa"):
        spark.createDataFrame([(1, text)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        count_new_documents(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = total_counts(spark, str(tmp_path / "out")).groupBy("lemma").agg(F.sum("frequency").alias("n")).collect()
    assert {r["lemma"]: r["n"] for r in got} == {"aa": 2, "bb": 1}


def odd_tei(n, encoding):
    """Sentences by a prefix, nested, commented out, in CDATA, and words with children, entities and comments inside."""
    one = '<t:s xml:id="d.{i}"><t:w xml:id="d.{i}.1" lemma="a" join="right">š&amp;<!-- </t:s> -->x<t:note>no</t:note>no</t:w><t:s id="d.{i}.in"><t:pc id="d.{i}.2"><![CDATA[</s>]]></t:pc></t:s ><t:linkGrp><t:link dep="d.{i}.1" from="d.{i}" afun="root"/></t:linkGrp></t:s >'
    return (f'<?xml version="1.0" encoding="{encoding}"?><t:TEI xmlns:t="x"><t:p><!-- <t:s id="gone"><t:w>w</t:w></t:s> -->' + "\n".join(one.replace("{i}", str(i)) for i in range(n)) + "</t:p></t:TEI>").encode(encoding)


def test_tei_documents_are_read_in_pieces(spark, tmp_path):
    n, names = 60, ("a.xml", "b.xml.gz", "c.xml", "d.xml")
    for name, encoding in zip(names, ("utf-8", "utf-8", "utf-16", "iso-8859-2"), strict=True):
        data = odd_tei(n, encoding)
        (tmp_path / name).write_bytes(gzip.compress(data) if name.endswith("gz") else data)
    limits = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.sources.binaryFile.maxLength": "1000"}  # no document may come as one value
    was = {k: spark.conf.get(k) for k in limits}
    try:
        for k, v in limits.items():
            spark.conf.set(k, v)
        c = read_tei(spark, str(tmp_path))
        rows = c.sentences.orderBy("file_ix", "sent_ix").collect()
        links = c.edges.count()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    expected = [x for i in range(n) for x in ((f"d.{i}", ["š&x", "</s>"], ["a", "</s>"]), (f"d.{i}.in", ["</s>"], ["</s>"]))]
    assert [(r["sentence_id"], [t["form"] for t in r["tokens"][1:]], [t["lemma"] for t in r["tokens"][1:]]) for r in rows] == expected * len(names)
    assert [(r["file_ix"], r["sent_ix"]) for r in rows] == [(f, i) for f in range(len(names)) for i in range(2 * n)] and links == n * len(names)


@pytest.mark.parametrize("data", [b"<TEI><s><w>x</w></s>", b"<TEI><s><w>x</w></s></TEI", b"<TEI><s></w></s></TEI>"])
def test_broken_tei_raises(spark, tmp_path, data):
    (tmp_path / "a.xml").write_bytes(data)
    with pytest.raises(Exception, match="ParseError"):
        read_tei(spark, str(tmp_path)).sentences.collect()


def test_tei_sentences_come_before_the_document_ends():
    def endless():
        yield b"<TEI><p>"
        while True:
            yield b'<s id="x"><w id="x.1">a</w>'
            yield b"</s>"

    assert list(islice(tei_sentences(endless(), True), 1000)) == [("x", [("x.1", "a", None, "", "", False)], [])] * 1000


def test_tei_is_written_without_gathering_documents(spark, tmp_path, monkeypatch):
    text = "".join(f"# sent_id = s{i}\n1\tw<{i}\tw&{i}\tNOUN\t_\t_\t0\troot\t_\t_\n\n" for i in range(500))
    for name in "abc":
        (tmp_path / f"{name}.conllu").write_text(text)
    c = read_conllu(spark, str(tmp_path))
    monkeypatch.setattr(F, "collect_list", lambda *_: pytest.fail("a document is gathered in a row"))
    write_tei(c, str(tmp_path / "tei"), buckets=2)
    read = read_tei(spark, str(tmp_path / "tei"))
    said = lambda x: [(r["sentence_id"], r["tokens"][1]["form"], r["tokens"][1]["lemma"], r["tokens"][1]["msd"]) for r in x.sentences.orderBy("file_ix", "sent_ix").collect()]
    assert said(read) == said(c) and read.edges.count() == 1500
