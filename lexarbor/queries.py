"""Registered queries of the engine, and the same in DuckDB SQL. All run over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.association import delta_p, log_dice
from .functions.predicates import accepts
from .functions.tags import decode_msd, split_msd, translate_msd
from .operators import collocations as C
from .operators import represent as R
from .operators.matcher import fixed_order, match_catalogue, match_structure
from .plans.report import Analysis
from .plans.structures import parse_catalogue
from .sources.corpus import FIELDS, Corpus, documents_corpus, orders_corpus, read_conllu, read_tei
from .sources.lexicon import build_lexicon, find_forms
from .sources.sinks import write_conllu, write_tei
from .sources.staging import shared_dir


def docs(spark, d: str) -> Corpus:
    """The documents table as a treebank. A scan of fewer splits than cores (a small table) is dealt out; a large one stays where it is."""
    rows, cores = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.sparkContext.defaultParallelism
    return documents_corpus(rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores))


def orders(spark, d: str) -> Corpus:
    return orders_corpus(spark.read.parquet(f"{d}/lineitem.parquet"), spark.read.parquet(f"{d}/part.parquet"))


def catalogue(*structures: str, system: str = "UD") -> str:
    return f'<syntactic_structures system_type="{system}">{"".join(structures)}</syntactic_structures>'


def pattern(*deps: str, system: str = "UD", **options) -> str:
    """A catalogue of one structure."""
    return catalogue(structure(*deps, **options), system=system)


def structure(*deps: str, name: str = "p", restrict: dict[str, str] | None = None, status: dict[str, str] | None = None, show: dict[str, str] | None = None, other: tuple[str, ...] = ()) -> str:
    """A structure; a dependency is `from to label [order]`."""
    cids = sorted({d.split()[1] for d in deps})
    comps = "".join(f'<component cid="{c}" type="{"other" if c in other else "core"}"{f""" status="{status[c]}" """ if status and c in status else ""}/>' for c in cids)
    links = "".join('<dependency from="{}" to="{}" label="{}"{}/>'.format(*p[:3], f' order="{p[3]}"' if len(p) > 3 else "") for p in map(str.split, deps))
    body = "".join(f'<component cid="{c}">{(restrict or {}).get(c, "")}<representation>{(show or {}).get(c, """<feature rendition="lemma"/>""")}</representation></component>' for c in cids)
    return f'<syntactic_structure type="collocation" id="{name}"><components>{comps}</components><dependencies>{links}</dependencies><definition>{body}</definition></syntactic_structure>'


def morph(**features: str) -> str:
    return '<restriction type="morphology">' + "".join(f'<feature {k}="{v}"/>' for k, v in features.items()) + "</restriction>"


TOP = "# 1 #"


def counted(corpus: Corpus, xml: str, *cids: str, ordered: bool = False) -> DataFrame:
    """Lemmas of the named components with the number of embeddings."""
    found = match_structure(corpus, parse_catalogue(xml, statistics=False).structures[0])
    found = fixed_order(found) if ordered else found
    lemmas = [F.try_element_at("words", F.lit(c))["lemma"].alias(f"l{c}") for c in cids]
    return found.select(*lemmas).groupBy(*(f"l{c}" for c in cids)).agg(F.count("*").alias("frequency"))


EDGE, CHAIN = pattern(TOP, "1 2 amod"), pattern(TOP, "1 2 obl", "2 3 case", other=("3",))
FORK, FOUR = pattern(TOP, "1 2 amod", "1 3 advmod", other=("3",)), pattern(TOP, "1 2 obj|obl|nsubj", "2 3 amod", "2 4 case", other=("3", "4"))
OPTIONAL, FORBIDDEN = pattern(TOP, "1 2 amod", "1 3 case", status={"3": "optional"}, other=("3",)), pattern(TOP, "1 2 amod", "1 3 case", status={"3": "forbidden"}, other=("3",))
NOUN_ADJ = pattern(TOP, "1 2 amod", restrict={"1": morph(POS="NOUN|VERB", Case="Nom"), "2": morph(Number="Sing", POS="ADJ")})
LEXIS = pattern(TOP, "1 2 amod", restrict={"1": '<restriction type="lexis"><feature lemma="the|of|la|le"/></restriction>'})
EITHER = pattern(TOP, "1 2 amod", restrict={"1": '<restriction_or><restriction type="lexis"><feature lemma="the|la"/></restriction>' + morph(POS="ADV") + "</restriction_or>"})
SPACED = pattern(TOP, "1 2 amod", restrict={"1": '<restriction type="space"><feature contact="neither|both"/></restriction>', "2": '<restriction type="space"><feature contact="left|neither"/></restriction>'})
NEGATED = pattern(TOP, "1 2 amod", restrict={"1": '<restriction type="morphology"><feature POS="NOUN"/><feature Case="Gen" filter="negative"/></restriction>'})
BACKWARD = pattern(TOP, "1 2 amod to-from")


def tok_scan(spark, d):
    return docs(spark, d).tokens.where("NOT is_root").select("file_ix", "sent_ix", "tok", "form", "lemma", "pos", "msd")


def tok_links(spark, d):
    return docs(spark, d).edges.groupBy("label", F.col("dep.pos").alias("pos")).agg(F.count("*").alias("n"), F.sum("head.tok").cast("long").alias("heads"))


def _pairs(xml, *cids, **options):
    return lambda spark, d: counted(docs(spark, d), xml, *cids, **options)


def filter_morphology_tokens(spark, d):
    component = parse_catalogue(NOUN_ADJ, statistics=False).structures[0].components[0]
    rows = docs(spark, d).tokens.select("file_ix", F.struct(*FIELDS).alias("t")).where(accepts(component, F.col("t"), True))
    return rows.groupBy("t.lemma").agg(F.count("*").alias("n"))


def uniq_words(spark, d):
    return C.uniq_words(docs(spark, d)).drop("pos")


def lowercase_forms(spark, d):
    return C.lowercase_forms(C.uniq_words(docs(spark, d))).groupBy("lemma", "msd", "text").agg(F.sum("frequency").alias("frequency"))


def word_counts(spark, d):
    return C.word_counts(C.uniq_words(docs(spark, d)))


def corpus_size(spark, d):
    return C.corpus_size(docs(spark, d))


def _edge_matches(corpus: Corpus) -> DataFrame:
    return C.with_keys(match_structure(corpus, parse_catalogue(EDGE, statistics=False).structures[0]))


def colloc_ids(spark, d):
    found = C.collocations(_edge_matches(orders(spark, d)))
    return found.select("collocation_id", F.get("key", F.lit(0))["lemma"].alias("l1"), F.get("key", F.lit(1))["lemma"].alias("l2"), "frequency")


def colloc_minfreq(spark, d):
    return counted(docs(spark, d), EDGE, "1", "2").where("frequency >= 5")


def dispersion(spark, d):
    return C.dispersions(C.collocations(_edge_matches(orders(spark, d))), 3).select("cid", "lemma", "dispersion")


def distinct_forms(spark, d):
    found = match_structure(docs(spark, d), parse_catalogue(EDGE, statistics=False).structures[0])
    w = lambda c, f: F.col("words")[c][f]
    return found.groupBy(w("1", "lemma").alias("l1"), w("2", "lemma").alias("l2")).agg(F.count_distinct(F.concat_ws(" ", w("1", "form"), w("2", "form"))).alias("distinct_forms"))


def association(spark, d):
    corpus = orders(spark, d)
    found = match_structure(corpus, parse_catalogue(EDGE, statistics=False).structures[0])
    w = lambda c, f: F.col("words")[c][f].alias(f"{f}{c}")
    pairs = found.select("found", w("1", "lemma"), w("2", "lemma"), w("1", "pos"), w("2", "pos")).groupBy("lemma1", "lemma2").agg(F.count("*").alias("frequency"), F.min_by(F.struct("pos1", "pos2"), "found").alias("p"))
    counts = C.word_counts(C.uniq_words(corpus))
    for i in "12":
        own = counts.select(F.col("lemma").alias(f"lemma{i}"), F.col("pos").alias("q"), F.col("frequency").alias(f"f{i}"))
        pairs = pairs.withColumn("q", F.col(f"p.pos{i}")).join(own, [f"lemma{i}", "q"]).drop("q")
    rows = pairs.join(F.broadcast(C.corpus_size(corpus)))
    f, x, y, n = (F.col(c) for c in ("frequency", "f1", "f2", "n"))
    six = lambda c: F.round(c, 6)
    return rows.select("lemma1", "lemma2", "frequency", six(delta_p(f, x, y, n)).alias("delta_p12"), six(delta_p(f, y, x, n)).alias("delta_p21"), six(14 + F.log2(2 * f / (x + y))).alias("logdice_core"), six(log_dice(f, F.array(x, y))).alias("logdice_all"))


def modal_order(spark, d):
    found = match_structure(docs(spark, d), parse_catalogue(FORK, statistics=False).structures[0])
    at = F.transform(F.array_sort(F.transform(F.map_entries("words"), lambda e: F.struct(e["value"]["int_id"].alias("i"), e["key"].alias("c")))), lambda x: x["c"])
    lemma = lambda c: F.col("words")[c]["lemma"].alias(f"l{c}")
    rows = found.select("found", lemma("1"), lemma("2"), lemma("3"), F.array_join(at, "").alias("order")).groupBy("l1", "l2", "l3", "order").agg(F.count("*").alias("n"), F.min("found").alias("seen"))
    return rows.groupBy("l1", "l2", "l3").agg(F.min_by("order", F.struct(-F.col("n"), "seen")).alias("order"))


def rep_any(spark, d):
    return R.most_frequent_forms(C.uniq_words(docs(spark, d)))


def rep_all_forms(spark, d):
    """The lower-case forms of every lemma, each lemma as a collocation of one component."""
    words = docs(spark, d).tokens.where("NOT is_root")
    rows = words.select(F.col("lemma").alias("collocation_id"), F.lit("1").alias("cid"), F.lit(0).alias("rep"), F.struct("file_ix", "sent_ix", "tok").alias("found"), F.struct("form", "msd").alias("w"))
    return R.all_forms(rows).select(F.col("collocation_id").alias("lemma"), F.col("text").alias("forms"), F.size(F.split("msd", "/")).alias("n"))


def _rep(feature: str, head: str = '<feature rendition="lemma"/>'):
    """The representative form of component 2 of the edge pattern, by collocation, through the representation operator."""
    xml = pattern(TOP, "1 2 amod", show={"1": head, "2": feature})

    def run(spark, d):
        a = Analysis(orders(spark, d), parse_catalogue(xml))
        ids = a.collocations.select("collocation_id", F.get("key", F.lit(0))["lemma"].alias("l1"), F.get("key", F.lit(1))["lemma"].alias("l2"))
        return a.representations.where("cid = '2'").join(ids, "collocation_id").select("l1", "l2", "text")

    return run


def lexicon_build(spark, d):
    return build_lexicon(_forms(spark, d)).drop("rank")


def _forms(spark, d) -> DataFrame:
    """Parts as a form list: brand, tag and type with their number."""
    part = spark.read.parquet(f"{d}/part.parquet")
    tag = F.concat(F.lit("Nc"), F.element_at(F.array(*map(F.lit, "mfn")), (F.col("p_size") % 3 + 1).cast("int")), F.element_at(F.array(*map(F.lit, "sdp")), (F.length("p_type") % 3 + 1).cast("int")), F.lit("n"))
    return part.groupBy(F.col("p_brand").alias("lemma"), tag.alias("msd"), F.col("p_type").alias("form")).agg(F.count("*").alias("frequency"))


def lexicon_lookup(spark, d):
    asked = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_brand").alias("lemma")).distinct().withColumn("need", F.create_map(F.lit("gender"), F.lit("feminine")))
    return find_forms(asked, build_lexicon(_forms(spark, d))).select("lemma", "form", "form_msd")


def msd_decode(spark, d):
    feats = decode_msd(F.col("msd"))
    return _forms(spark, d).select("msd").distinct().select("msd", *(feats[k].alias(n) for k, n in (("pos", "pos"), ("gender", "gender"), ("number", "number"), ("case", "gcase"))))


def msd_translate(spark, d):
    """Tags in native spelling, made of the parts' columns, as they are stored, with the features of lexeme and form."""
    def pick(letters, column):
        return F.element_at(F.array(*map(F.lit, letters)), (F.col(column) % len(letters) + 1).cast("int"))

    gender, number, case, person = pick("mzs", "p_size"), pick("edm", "p_partkey"), pick("irdtmo", "p_size"), pick("pdt", "p_partkey")
    kinds = (("So", gender, number, case), ("Gg", pick("dnv", "p_size"), F.lit("s"), person, number), ("Ppp", gender, number, case), ("Zs", person, gender, number, case, pick("edm", "p_size")), ("Kbv", gender, number, case), ("D", case))
    native = F.explode(F.array(*(F.concat(F.lit(head), *rest) for head, *rest in kinds)))
    tags = spark.read.parquet(f"{d}/part.parquet").select("p_size", "p_partkey").select(native.alias("native")).groupBy("native").agg(F.count("*").alias("n"))
    parts = tags.select("native", "n", translate_msd(F.col("native")).alias("msd")).withColumn("f", split_msd(F.col("msd")))
    said = lambda side: F.array_join(F.array_sort(F.transform(F.map_entries(F.col(f"f.{side}")), lambda e: F.concat_ws("=", e["key"], e["value"]))), "|")
    return parts.select("native", "msd", "n", said("lexeme").alias("lexeme"), said("form").alias("form"))


def sz_kh_words(spark, d):
    """The settled first lemma of s, z, k and h before every word of the whole texts, with the number of such words."""
    words = docs(spark, d).tokens.where("NOT is_root").groupBy("lemma").agg(F.count("*").alias("frequency"))
    rows = words.select("lemma", "frequency", F.explode(F.array(*map(F.lit, "szkh"))).alias("p"))
    token = lambda c: F.struct(F.col(c).alias("lemma"))
    key = C.collocation_key(F.map_from_entries(F.array(F.struct(F.lit("1").alias("key"), token("p").alias("value")), F.struct(F.lit("2").alias("key"), token("lemma").alias("value")))))
    return rows.select("lemma", "p", F.get(key, F.lit(0))["lemma"].alias("settled"), "frequency")


def read_conllu_tokens(spark, d):
    """The documents treebank written as CoNLL-U files and read again."""
    path = f"{shared_dir(spark)}/conllu-{uuid.uuid4().hex}"
    write_conllu(docs(spark, d), path)
    return read_conllu(spark, path).tokens.where("NOT is_root").select("sentence_id", "tok", "form", "lemma", "pos", "msd", "glue")


def read_tei_links(spark, d):
    """The orders treebank written as TEI documents, one per bucket of orders, and read again."""
    path = f"{shared_dir(spark)}/tei-{uuid.uuid4().hex}"
    write_tei(orders(spark, d), path, buckets=16)
    edges = read_tei(spark, path).edges
    return edges.select("sentence_id", "label", F.col("head.tok").alias("head"), F.col("dep.tok").alias("tok"), F.col("dep.form").alias("form"), F.col("dep.lemma").alias("lemma"), F.col("dep.msd").alias("msd"))


def jos_orders(spark, d) -> Corpus:
    """The orders treebank with positional tags and English labels of the positional system, through CoNLL-U files."""
    tag = lambda t: F.concat(F.element_at(F.create_map(*map(F.lit, ("NOUN", "Nc", "ADJ", "Agp", "VERB", "Vm", "ADV", "Rg", "ADP", "S"))), t["pos"]), F.when(t["pos"].isin("NOUN", "ADJ"), F.concat(F.element_at(F.array(*map(F.lit, "mfn")), (F.length(t["lemma"]) % 3 + 1).cast("int")), F.when(t["tok"] % 2 == 0, "s").otherwise("p"), F.lower(F.substring(t["msd"], 6, 1)))).otherwise(""))
    said = F.create_map(*map(F.lit, ("root", "Root", "amod", "Atr", "advmod", "AdvM", "case", "Conj", "conj", "Coord", "obj", "Obj", "obl", "AdvO", "nsubj", "Sb")))
    tokens = F.transform("tokens", lambda t: t.withField("msd", F.when(t["is_root"], "").otherwise(tag(t))))
    links = F.transform("links", lambda x: x.withField("label", said[x["label"]]))
    path = f"{shared_dir(spark)}/jos-{uuid.uuid4().hex}"
    write_conllu(Corpus(orders(spark, d).sentences.select("file_ix", "sent_ix", "sentence_id", tokens.alias("tokens"), links.alias("links")), ud=False), path)
    return read_conllu(spark, path, ud=False, jos_labels="en")


JOS = pattern(TOP, "1 2 dol", system="JOS", restrict={"1": morph(POS="noun", gender="masculine|feminine"), "2": '<restriction type="morphology"><feature POS="adjective"/><feature case="genitive" filter="negative"/></restriction>'})


def jos_match(spark, d):
    """A pattern of the positional system; its core pair is told by the restrictions."""
    found = match_catalogue(jos_orders(spark, d), parse_catalogue(JOS))
    w = lambda c, f: F.col("words")[c][f].alias(f"{f}{c}")
    return found.groupBy(w("1", "lemma"), w("2", "lemma"), w("1", "msd"), w("2", "msd")).agg(F.count("*").alias("frequency"))


REPORT_XML = catalogue(*(structure(TOP, f"1 2 {label}", name=name, show={"2": '<feature rendition="word_form"/>'}) for name, label in (("p", "amod"), ("q", "advmod"))))


def colloc_report(spark, d):
    """The full report of two structures, its doubles to six decimals."""
    found = Analysis(orders(spark, d), parse_catalogue(REPORT_XML)).report
    return found.select(*(F.round(F.col(c), 6).alias(c) if kind == "double" else F.col(c) for c, kind in found.dtypes))


def sentence_map(spark, d):
    return Analysis(orders(spark, d), parse_catalogue(EDGE)).sentence_map


QUERIES = {
    "tok_scan": tok_scan, "tok_links": tok_links, "filter_tokens": filter_morphology_tokens,
    "filter_morphology": _pairs(NOUN_ADJ, "1", "2"), "filter_negated": _pairs(NEGATED, "1", "2"), "filter_lexis": _pairs(LEXIS, "1", "2"), "filter_or": _pairs(EITHER, "1", "2"), "filter_space": _pairs(SPACED, "1", "2"),
    "match_edge": _pairs(EDGE, "1", "2"), "match_chain": _pairs(CHAIN, "1", "2", "3"), "match_fork": _pairs(FORK, "1", "2", "3"), "match_four": _pairs(FOUR, "1", "2", "3", "4"),
    "match_optional": _pairs(OPTIONAL, "1", "2", "3"), "match_forbidden": _pairs(FORBIDDEN, "1", "2"), "match_order": _pairs(BACKWARD, "1", "2"), "match_fixed_order": _pairs(FORK, "1", "2", "3", ordered=True),
    "colloc_ids": colloc_ids, "colloc_minfreq": colloc_minfreq, "uniq_words": uniq_words, "lowercase_forms": lowercase_forms, "word_counts": word_counts, "corpus_size": corpus_size,
    "dispersion": dispersion, "distinct_forms": distinct_forms, "modal_order": modal_order, "association": association,
    "rep_any": rep_any, "rep_all_forms": rep_all_forms, "rep_lexis": _rep('<feature rendition="lexis" string="zz"/>'), "rep_lemma": _rep('<feature rendition="lemma"/>'), "rep_word_form": _rep('<feature rendition="word_form"/>'), "rep_lowercase": _rep('<feature rendition="word_form"/><feature selection="all"/><feature format="lowercase"/>'),
    "rep_msd": _rep('<feature rendition="word_form"/><feature selection="msd" Case="Nom"/>'), "rep_agreement": _rep('<feature rendition="word_form"/><feature selection="agreement" msd="case" head_cid="1"/>', head='<feature rendition="word_form"/>'),
    "read_conllu": read_conllu_tokens, "read_tei": read_tei_links, "jos_match": jos_match,
    "lexicon_build": lexicon_build, "lexicon_lookup": lexicon_lookup, "msd_decode": msd_decode, "msd_translate": msd_translate, "sz_kh_words": sz_kh_words, "colloc_report": colloc_report, "sentence_map": sentence_map,
}

TOK = r"""
WITH lines AS (SELECT doc_id AS file_ix, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS sent_ix FROM documents),
forms AS (SELECT file_ix, sent_ix, list_filter(string_split_regex(line, '[ \t\r]+'), lambda x: x <> '') AS f FROM lines),
words AS (SELECT file_ix, sent_ix, len(f) AS n, unnest(f) AS form, generate_subscripts(f, 1) AS tok FROM forms),
cut AS (SELECT *, lower(regexp_replace(form, '[^\p{L}\p{N}]+$', '')) AS c FROM words),
lem AS (SELECT *, CASE WHEN c = '' THEN lower(form) ELSE c END AS lemma FROM cut),
t AS (
    SELECT file_ix, sent_ix, n, c <> lower(form) AS glue, CAST(tok AS INTEGER) AS tok, form, lemma, (['NOUN', 'VERB', 'ADJ', 'ADV', 'ADP', 'NOUN'])[length(lemma) % 6 + 1] AS pos,
           'Case=' || (['Nom', 'Acc', 'Gen'])[tok % 3 + 1] || '|Number=' || CASE WHEN length(lemma) % 2 = 0 THEN 'Sing' ELSE 'Plur' END || '|POS=' || (['NOUN', 'VERB', 'ADJ', 'ADV', 'ADP', 'NOUN'])[length(lemma) % 6 + 1] AS msd
    FROM lem)"""
ORD = r"""
WITH r AS (SELECT l_orderkey AS file_ix, 0 AS sent_ix, count(*) OVER (PARTITION BY l_orderkey) AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS tok, CASE l_linenumber % 4 WHEN 0 THEN p_brand WHEN 1 THEN lower(p_brand) ELSE p_brand || 's' END AS form, lower(p_brand) AS lemma, CASE l_returnflag WHEN 'A' THEN 'Nom' WHEN 'N' THEN 'Acc' ELSE 'Gen' END AS gcase, (['NOUN', 'VERB', 'ADJ', 'ADV', 'ADP', 'NOUN'])[p_size % 6 + 1] AS pos FROM lineitem JOIN part ON l_partkey = p_partkey),
t AS (SELECT *, 'Case=' || gcase || '|POS=' || pos AS msd FROM r)"""
LABELLED = """,
e AS (
    SELECT t.*, CASE WHEN (t.file_ix + t.sent_ix) % 2 = 0 THEN t.tok // 2 WHEN t.tok = t.n THEN 0 ELSE t.n + 1 - (t.n + 1 - t.tok) // 2 END AS head,
           CASE WHEN head = 0 THEN 'root' WHEN pos = 'ADV' THEN 'advmod' WHEN pos = 'ADJ' THEN 'amod' WHEN pos = 'ADP' THEN 'case' WHEN pos = 'VERB' THEN 'conj' ELSE (['obj', 'obl', 'nsubj'])[t.tok % 3 + 1] END AS label FROM t)"""


def _join(child: str, parent: str, label: str, kind: str = "JOIN") -> str:
    labels = ", ".join(f"'{x}'" for x in label.split("|"))
    return f" {kind} e {child} ON {child}.file_ix = {parent}.file_ix AND {child}.sent_ix = {parent}.sent_ix AND {child}.head = {parent}.tok AND {child}.label IN ({labels})"


def _counted(joins: str, names: dict[str, str], where: str = "true") -> str:
    columns = ", ".join(f"{alias}.lemma AS {name}" for name, alias in names.items())
    return f"{TOK}{LABELLED} SELECT {columns}, count(*) AS frequency FROM t a{joins} WHERE {where} GROUP BY ALL"


_E, _N = _join("b", "a", "amod"), {"l1": "a", "l2": "b"}
_FORK = _E + _join("c", "a", "advmod")
_REP = f"{ORD}{LABELLED} SELECT a.lemma AS l1, b.lemma AS l2, {{}} AS text FROM t a{_E} GROUP BY ALL"
_BEST = f"""{ORD}{LABELLED},
u AS (SELECT lemma, msd, form AS text, count(*) AS f FROM t GROUP BY ALL),
w AS (SELECT a.lemma, a.msd, CASE WHEN b.f IS NULL THEN a.text ELSE lower(a.text) END AS text, a.f FROM u a LEFT JOIN u b ON a.lemma = b.lemma AND a.msd = b.msd AND b.text = lower(a.text) AND a.text[1] = upper(a.text[1]) AND a.text[1] <> lower(a.text[1]) AND b.f <= a.f AND b.f >= 0.1 * a.f),
best AS (SELECT lemma, msd, text FROM (SELECT *, row_number() OVER (PARTITION BY lemma, msd ORDER BY f DESC, text) AS k FROM w) WHERE k = 1)"""
_TAGS = f"m AS (SELECT a.lemma AS l1, b.lemma AS l2, a.msd AS am, b.msd AS bm FROM t a{_E}), c AS (SELECT l1, l2, bm, row_number() OVER (PARTITION BY l1, l2 ORDER BY count(*) DESC, bm) AS k FROM m GROUP BY l1, l2, bm)"
def _picked(words, column: str) -> str:
    return "([" + ", ".join(f"'{w}'" for w in words) + f"])[{column} % {len(words)} + 1]"


_AT = {"g": "p_size", "n": "p_partkey", "c": "p_size", "p": "p_partkey", "a": "p_size", "o": "p_size"}
_SAID = {  # native letters, stored letters, feature and values
    "g": ("mzs", "mfn", "gender", ("masculine", "feminine", "neuter")), "n": ("edm", "sdp", "number", ("singular", "dual", "plural")),
    "c": ("irdtmo", "ngdali", "case", ("nominative", "genitive", "dative", "accusative", "locative", "instrumental")),
    "p": ("pdt", "123", "person", ("first", "second", "third")), "a": ("dnv", "epb", "aspect", ("perfective", "progressive", "biaspectual")),
    "o": ("edm", "sdp", "owner_number", ("singular", "dual", "plural")),
}


def _tagged(parts: tuple, lexeme: tuple, form: tuple) -> str:
    """A made tag: parts are (native, stored) texts or keys of _SAID; lexeme and form are said features, by name."""
    spell = lambda k: " || ".join(f"'{x[k]}'" if isinstance(x, tuple) else _picked(_SAID[x][k], _AT[x]) for x in parts)
    said = lambda names: " || '|' || ".join(f"'{x}'" if "=" in x else f"'{_SAID[x][2]}=' || {_picked(_SAID[x][3], _AT[x])}" for x in names) or "''"
    return f"SELECT {spell(0)} AS native, {spell(1)} AS msd, {said(lexeme)} AS lexeme, {said(form)} AS form FROM part"


_FORMS = """
WITH forms AS (SELECT p_brand AS lemma, 'Nc' || (['m', 'f', 'n'])[p_size % 3 + 1] || (['s', 'd', 'p'])[length(p_type) % 3 + 1] || 'n' AS msd, p_type AS form, count(*) AS frequency FROM part GROUP BY ALL),
lex AS (SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY lemma, msd ORDER BY frequency DESC, form) AS n FROM forms) WHERE n = 1)"""
SQL = {
    "tok_scan": f"{TOK} SELECT file_ix, sent_ix, tok, form, lemma, pos, msd FROM t",
    "tok_links": f"{TOK}{LABELLED} SELECT label, pos, count(*) AS n, CAST(sum(head) AS BIGINT) AS heads FROM e GROUP BY ALL",
    "filter_tokens": f"{TOK} SELECT lemma, count(*) AS n FROM t WHERE pos IN ('NOUN', 'VERB') AND msd LIKE 'Case=Nom|%' GROUP BY lemma",
    "filter_morphology": _counted(_E, _N, "a.pos IN ('NOUN', 'VERB') AND a.msd LIKE 'Case=Nom|%' AND b.pos = 'ADJ' AND b.msd LIKE '%|Number=Sing|%'"),
    "filter_negated": _counted(_E, _N, "a.pos = 'NOUN' AND a.msd NOT LIKE 'Case=Gen|%'"),
    "filter_lexis": _counted(_E, _N, "a.lemma IN ('the', 'of', 'la', 'le')"),
    "filter_or": _counted(_E, _N, "a.lemma IN ('the', 'la') OR a.pos = 'ADV'"),
    "filter_space": f"{TOK}, g AS (SELECT file_ix, sent_ix, tok, glue, coalesce(lag(glue) OVER (PARTITION BY file_ix, sent_ix ORDER BY tok), false) AS pglue FROM t){LABELLED} SELECT a.lemma AS l1, b.lemma AS l2, count(*) AS frequency FROM t a{_E} JOIN g x ON x.file_ix = a.file_ix AND x.sent_ix = a.sent_ix AND x.tok = a.tok JOIN g y ON y.file_ix = b.file_ix AND y.sent_ix = b.sent_ix AND y.tok = b.tok WHERE x.glue = x.pglue AND NOT y.glue GROUP BY ALL",
    "match_edge": _counted(_E, _N),
    "match_chain": _counted(_join("b", "a", "obl") + _join("c", "b", "case"), _N | {"l3": "c"}),
    "match_fork": _counted(_FORK, _N | {"l3": "c"}),
    "match_four": _counted(_join("b", "a", "obj|obl|nsubj") + _join("c", "b", "amod") + _join("d", "b", "case"), _N | {"l3": "c", "l4": "d"}),
    "match_optional": _counted(_E + _join("c", "a", "case", "LEFT JOIN"), _N | {"l3": "c"}),
    "match_forbidden": _counted(_E, _N, "NOT EXISTS (SELECT 1 FROM e c WHERE c.file_ix = a.file_ix AND c.sent_ix = a.sent_ix AND c.head = a.tok AND c.label = 'case')"),
    "match_order": _counted(_E, _N, "a.tok > b.tok"),
    "match_fixed_order": _counted(_FORK, _N | {"l3": "c"}, "a.tok <= b.tok AND b.tok <= c.tok"),
    "colloc_ids": f"{ORD}{LABELLED}, m AS (SELECT a.lemma AS l1, b.lemma AS l2, count(*) AS frequency, min((a.file_ix, a.tok, b.tok)) AS seen FROM t a{_E} GROUP BY ALL) SELECT row_number() OVER (ORDER BY seen) AS collocation_id, l1, l2, frequency FROM m",
    "colloc_minfreq": f"SELECT * FROM ({_counted(_E, _N)}) WHERE frequency >= 5",
    "uniq_words": f"{TOK} SELECT lemma, msd, form AS text, count(*) AS frequency FROM t GROUP BY ALL",
    "lowercase_forms": f"{TOK}, u AS (SELECT lemma, msd, form AS text, count(*) AS f FROM t GROUP BY ALL) SELECT a.lemma, a.msd, CASE WHEN b.f IS NULL THEN a.text ELSE lower(a.text) END AS text, CAST(sum(a.f) AS BIGINT) AS frequency FROM u a LEFT JOIN u b ON a.lemma = b.lemma AND a.msd = b.msd AND b.text = lower(a.text) AND a.text[1] = upper(a.text[1]) AND a.text[1] <> lower(a.text[1]) AND b.f <= a.f AND b.f >= 0.1 * a.f GROUP BY ALL",
    "word_counts": f"{TOK} SELECT lemma, pos, count(*) AS frequency FROM t GROUP BY ALL",
    "corpus_size": f"{TOK} SELECT count(*) + count(DISTINCT (file_ix, sent_ix)) AS n FROM t",
    "dispersion": f"{ORD}{LABELLED}, m AS (SELECT a.lemma AS l1, b.lemma AS l2 FROM t a{_E} GROUP BY ALL HAVING count(*) >= 3) SELECT '1' AS cid, l1 AS lemma, count(*) AS dispersion FROM m GROUP BY l1 UNION ALL SELECT '2', l2, count(*) FROM m GROUP BY l2",
    "distinct_forms": f"{TOK}{LABELLED} SELECT a.lemma AS l1, b.lemma AS l2, count(DISTINCT a.form || ' ' || b.form) AS distinct_forms FROM t a{_E} GROUP BY ALL",
    "modal_order": f"{TOK}{LABELLED}, m AS (SELECT a.lemma AS l1, b.lemma AS l2, c.lemma AS l3, array_to_string(list_transform(list_sort([(a.tok, '1'), (b.tok, '2'), (c.tok, '3')]), lambda x: x[2]), '') AS o, count(*) AS n, min((a.file_ix, a.sent_ix, a.tok)) AS seen FROM t a{_FORK} GROUP BY ALL) SELECT l1, l2, l3, o AS \"order\" FROM (SELECT *, row_number() OVER (PARTITION BY l1, l2, l3 ORDER BY n DESC, seen) AS k FROM m) WHERE k = 1",
    "association": f"{ORD}{LABELLED}, m AS (SELECT a.lemma AS lemma1, b.lemma AS lemma2, count(*) AS f, arg_min(a.pos, (a.file_ix, a.tok, b.tok)) AS p1, arg_min(b.pos, (a.file_ix, a.tok, b.tok)) AS p2 FROM t a{_E} GROUP BY ALL), w AS (SELECT lemma, pos, count(*) AS f FROM t GROUP BY ALL), n AS (SELECT count(*) + count(DISTINCT file_ix) AS n FROM t) SELECT lemma1, lemma2, m.f AS frequency, round(m.f / x.f - (y.f - m.f) / (n - x.f), 6) AS delta_p12, round(m.f / y.f - (x.f - m.f) / (n - y.f), 6) AS delta_p21, round(14 + log2(2 * m.f / (x.f + y.f)), 6) AS logdice_core, round(14 + log2(2 * m.f / (x.f + y.f)), 6) AS logdice_all FROM m JOIN w x ON x.lemma = lemma1 AND x.pos = p1 JOIN w y ON y.lemma = lemma2 AND y.pos = p2, n",
    "rep_any": f"{TOK} SELECT lemma, msd, form AS text FROM (SELECT lemma, msd, form, row_number() OVER (PARTITION BY lemma, msd ORDER BY count(*) DESC, form) AS k FROM t GROUP BY lemma, msd, form) WHERE k = 1",
    "rep_all_forms": f"{TOK} SELECT lemma, string_agg(f, '/' ORDER BY f) AS forms, CAST(count(*) AS INTEGER) AS n FROM (SELECT DISTINCT lemma, lower(form) AS f FROM t) GROUP BY lemma",
    "rep_lexis": _REP.format("'zz'"), "rep_lemma": _REP.format("b.lemma"), "rep_lowercase": _REP.format("string_agg(DISTINCT lower(b.form), '/' ORDER BY lower(b.form))"),
    "rep_word_form": f"{_BEST}, {_TAGS} SELECT l1, l2, text FROM c JOIN best ON best.lemma = l2 AND best.msd = bm WHERE k = 1",
    "rep_msd": f"{_BEST}, {_TAGS}, n AS (SELECT * FROM c JOIN best ON best.lemma = l2 AND best.msd = bm WHERE bm LIKE 'Case=Nom|%') SELECT l1, l2, n.text FROM (SELECT DISTINCT l1, l2 FROM m) LEFT JOIN n USING (l1, l2)",
    "rep_agreement": f"{_BEST}, {_TAGS}, h AS (SELECT l1, l2, am, row_number() OVER (PARTITION BY l1, l2 ORDER BY count(*) DESC, am) AS k FROM m GROUP BY l1, l2, am), n AS (SELECT l1, l2, arg_min(text, k) AS text FROM h JOIN best ON best.lemma = l2 AND best.msd = split_part(am, '|', 1) || '|POS=ADJ' GROUP BY l1, l2) SELECT l1, l2, n.text FROM (SELECT DISTINCT l1, l2 FROM m) LEFT JOIN n USING (l1, l2)",
    "read_conllu": f"{TOK} SELECT file_ix || '.' || sent_ix AS sentence_id, tok, form, lemma, pos, msd, glue FROM t",
    "read_tei": f"{ORD}{LABELLED} SELECT CAST(file_ix AS VARCHAR) AS sentence_id, label, CAST(head AS INTEGER) AS head, CAST(tok AS INTEGER) AS tok, form, lemma, msd FROM e",
    "jos_match": f"{ORD}{LABELLED}, j AS (SELECT *, (['m', 'f', 'n'])[length(lemma) % 3 + 1] || CASE WHEN tok % 2 = 0 THEN 's' ELSE 'p' END || lower(gcase[1]) AS tail FROM e) SELECT a.lemma AS lemma1, b.lemma AS lemma2, 'Nc' || a.tail AS msd1, 'Agp' || b.tail AS msd2, count(*) AS frequency FROM j a JOIN j b ON a.file_ix = b.file_ix AND b.head = a.tok AND b.label = 'amod' WHERE a.pos = 'NOUN' AND a.tail[1] IN ('m', 'f') AND b.gcase <> 'Gen' GROUP BY ALL",
    "colloc_report": f"""{_BEST},
m AS ({" UNION ALL ".join(f"SELECT '{name}' AS sid, {ix} AS six, a.file_ix, a.tok AS ta, b.tok AS tb, a.lemma AS l1, b.lemma AS l2, a.msd AS am, b.msd AS bm, a.pos AS ap, b.pos AS bp, a.form || ' ' || b.form AS ab FROM t a{_join('b', 'a', label)}" for ix, (name, label) in enumerate((("p", "amod"), ("q", "advmod"))))}),
k AS (SELECT sid, l1, l2, count(*) AS f, min((file_ix, six, ta, tb)) AS seen, arg_min(am, (file_ix, ta, tb)) AS m1, arg_min(ap, (file_ix, ta, tb)) AS p1, arg_min(bp, (file_ix, ta, tb)) AS p2, count(DISTINCT ab) AS forms FROM m GROUP BY ALL),
o AS (SELECT sid, l1, l2, first(ahead ORDER BY n DESC, seen) AS ahead FROM (SELECT sid, l1, l2, ta < tb AS ahead, count(*) AS n, min((file_ix, ta, tb)) AS seen FROM m GROUP BY ALL) GROUP BY ALL),
c AS (SELECT sid, l1, l2, bm, row_number() OVER (PARTITION BY sid, l1, l2 ORDER BY count(*) DESC, bm) AS n FROM m GROUP BY sid, l1, l2, bm),
wc AS (SELECT lemma, pos, count(*) AS f FROM t GROUP BY ALL), size AS (SELECT count(*) + count(DISTINCT file_ix) AS n FROM t)
SELECT sid AS "Structure_ID", l1 AS "C1_Lemma", l1 AS "C1_Representative_form", m1 AS "C1_RF_msd", 'ok' AS "C1_RF_scenario", count(*) OVER (PARTITION BY sid, l1) AS "C1_Distribution",
       l2 AS "C2_Lemma", best.text AS "C2_Representative_form", bm AS "C2_RF_msd", 'ok' AS "C2_RF_scenario", count(*) OVER (PARTITION BY sid, l2) AS "C2_Distribution",
       row_number() OVER (ORDER BY seen) AS "Collocation_ID", l1 || ' ' || best.text AS "Joint_representative_form_fixed", CASE WHEN ahead THEN l1 || ' ' || best.text ELSE best.text || ' ' || l1 END AS "Joint_representative_form_variable", k.f AS "Frequency",
       round(k.f / x.f - (y.f - k.f) / (size.n - x.f), 6) AS "Delta_p12", round(k.f / y.f - (x.f - k.f) / (size.n - y.f), 6) AS "Delta_p21", round(14 + log2(2 * k.f / (x.f + y.f)), 6) AS "LogDice_core", round(14 + log2(2 * k.f / (x.f + y.f)), 6) AS "LogDice_all", forms AS "Distinct_forms"
FROM k JOIN o USING (sid, l1, l2) JOIN c USING (sid, l1, l2) JOIN best ON best.lemma = l2 AND best.msd = bm JOIN wc x ON x.lemma = l1 AND x.pos = p1 JOIN wc y ON y.lemma = l2 AND y.pos = p2, size WHERE c.n = 1""",
    "lexicon_build": f"{_FORMS} SELECT lemma, msd, form, frequency FROM lex",
    "lexicon_lookup": f"{_FORMS}, k AS (SELECT *, row_number() OVER (PARTITION BY lemma ORDER BY frequency DESC, msd, form) AS n FROM lex WHERE msd[3] = 'f') SELECT b.lemma, k.form, k.msd AS form_msd FROM (SELECT DISTINCT lemma FROM forms) b LEFT JOIN k ON k.lemma = b.lemma AND k.n = 1",
    "msd_decode": f"{_FORMS} SELECT DISTINCT msd, 'noun' AS pos, CASE msd[3] WHEN 'm' THEN 'masculine' WHEN 'f' THEN 'feminine' ELSE 'neuter' END AS gender, CASE msd[4] WHEN 's' THEN 'singular' WHEN 'd' THEN 'dual' ELSE 'plural' END AS number, 'nominative' AS gcase FROM forms",
    "msd_translate": "SELECT native, msd, count(*) AS n, lexeme, form FROM (" + " UNION ALL ".join((
        _tagged((("So", "Nc"), "g", "n", "c"), ("g", "pos=noun", "type=common"), ("c", "n")),
        _tagged((("Gg", "Vm"), "a", ("s", "r"), "p", "n"), ("a", "pos=verb", "type=main"), ("n", "p", "vform=present")),
        _tagged((("Ppp", "Agc"), "g", "n", "c"), ("pos=adjective", "type=general"), ("c", "degree=comparative", "g", "n")),
        _tagged((("Zs", "Ps"), "p", "g", "n", "c", "o"), ("pos=pronoun", "type=possessive"), ("c", "g", "n", "o", "p")),
        _tagged((("Kbv", "Mlo"), "g", "n", "c"), ("form=letter", "pos=numeral", "type=ordinal"), ("c", "g", "n")),
        _tagged((("D", "S"), "c"), ("c", "pos=preposition"), ()))) + ") GROUP BY ALL",
    "sz_kh_words": f"{TOK} SELECT lemma, p, CASE WHEN p IN ('s', 'z') THEN CASE WHEN lemma[1] IN ('c', 'č', 'f', 'h', 'k', 'p', 's', 'š', 't') THEN 's' ELSE 'z' END ELSE CASE WHEN lemma[1] IN ('g', 'k') THEN 'h' ELSE 'k' END END AS settled, count(*) AS frequency FROM t, (SELECT unnest(['s', 'z', 'k', 'h']) AS p) GROUP BY ALL",
    "sentence_map": f"{ORD}{LABELLED}, m AS (SELECT a.lemma AS l1, b.lemma AS l2, a.file_ix, a.tok AS ta, b.tok AS tb FROM t a{_E}), c AS (SELECT l1, l2, row_number() OVER (ORDER BY min((file_ix, ta, tb))) AS id FROM m GROUP BY l1, l2) SELECT c.id AS \"Collocation_id\", CAST(file_ix AS VARCHAR) AS \"Sentence_id\", file_ix || '.' || ta || '|' || file_ix || '.' || tb AS \"Token_ids\" FROM m JOIN c USING (l1, l2)",
}
