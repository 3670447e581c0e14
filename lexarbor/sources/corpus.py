"""Annotated corpora: a row per sentence, with its tokens and links as arrays, so that patterns are matched inside the row.

sentences: file_ix, sent_ix, sentence_id, tokens array<TOKEN>, links array<struct<head:int,dep:int,label:string>>
tokens:    file_ix, sent_ix, tok, sentence_id, token_id, int_id, form, lemma, msd, pos, glue, previous_glue, is_root

(file_ix, sent_ix) is the key of a sentence: sentence ids repeat over files. tok counts from 0, the artificial root.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate, chain, groupby
from operator import itemgetter
from types import SimpleNamespace
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.tags import translate_label, translate_msd

KEY = ("file_ix", "sent_ix")
TOKEN = "struct<tok:int,token_id:string,int_id:int,form:string,lemma:string,msd:string,pos:string,glue:boolean,previous_glue:boolean,is_root:boolean>"
FIELDS = tuple(x.split(":")[0] for x in TOKEN[7:-1].split(","))


@dataclass(frozen=True)
class Corpus:
    """sentences as above; ud tells the tag system: features by name, or positional tags."""

    sentences: DataFrame
    ud: bool = True

    @property
    def tokens(self) -> DataFrame:
        return self.sentences.select(*KEY, "sentence_id", F.explode("tokens").alias("t")).select(*KEY, "sentence_id", "t.*")

    @property
    def edges(self) -> DataFrame:
        """A row per link: head and dep are whole tokens. A link whose ends are not both in the sentence is left out."""
        at = lambda i: F.get("tokens", i)
        ends = F.transform("links", lambda x, i: F.struct(at(x["head"]).alias("head"), x["label"].alias("label"), i.alias("link_ix"), at(x["dep"]).alias("dep")))
        whole = F.filter(ends, lambda x: x["head"].isNotNull() & x["dep"].isNotNull())
        return self.sentences.select(*KEY, "sentence_id", F.explode(whole).alias("x")).select(*KEY, "sentence_id", "x.*")

    def union(self, other: Corpus) -> Corpus:
        return Corpus(self.sentences.unionByName(other.sentences), self.ud)


def _number(token_id: Column) -> Column:
    return F.coalesce(F.regexp_extract(token_id, r"(\d+)$", 1).try_cast("int"), F.lit(0))


def ud_msd(pos: Column, feats: Column) -> Column:
    """The tag of the UD system: the features `k=v|k=v` (`_` or null: none) in their order, POS last."""
    given = F.when(feats.isNull() | (feats == "_"), F.lit("")).otherwise(feats)
    return F.concat(given, F.when(given == "", "").otherwise("|"), F.lit("POS="), pos)


def positional(tag: Column, jos_tags: str) -> tuple[Column, Column]:
    """A positional tag as it is stored, and its category; with jos_tags="sl" it is given in native spelling."""
    stored = translate_msd(tag) if jos_tags == "sl" else tag
    return stored, F.substring(stored, 1, 1)


def _token(tok, token_id, form, lemma, msd, pos, glue=None, previous=None, root=False, number=None) -> Column:
    flag = lambda x: F.lit(False) if x is None else x
    token_id = token_id.cast("string")
    parts = (tok.cast("int"), token_id, _number(token_id) if number is None else number.cast("int"), form, lemma, msd, pos, flag(glue), flag(previous), F.lit(root))
    return F.struct(*(p.alias(n) for p, n in zip(parts, FIELDS, strict=True)))


def root_token() -> Column:
    """The artificial root: it heads the sentence, matches where nothing is asked, and counts in the corpus size."""
    empty = F.lit("")
    return _token(F.lit(0), F.lit("0"), empty, empty, empty, empty, root=True, number=F.lit(0))


def with_root(tokens: Column) -> Column:
    return F.concat(F.array(root_token()), tokens)


def input_files(spark: SparkSession, paths: str | list[str]) -> list[str]:
    """The files below paths in path order, from their listing alone, as scans name them (percent-encoded); .zstd files are skipped."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).inputFiles()
    found = sorted(re.sub("^file:///", "file:/", x) for x in found if not x.endswith(".zstd"))
    if not found:
        raise ValueError(f"no files in {paths}")
    return found


def file_numbers(spark: SparkSession, files: list[str]) -> DataFrame:
    """(path, file_ix): the driver holds the list of files anyway, as Spark plans a scan from it."""
    return spark.createDataFrame(list(zip(files, range(len(files)), strict=True)), "path string, file_ix int")


def read_conllu(spark: SparkSession, paths: str | list[str], *, ud: bool = True, jos_labels: str = "sl", jos_tags: str = "en", files: DataFrame | None = None) -> Corpus:
    """CoNLL-U and CoNLL-U Plus: a sentence is a run of lines up to an empty one; lines end with LF or CRLF.

    Columns are those of `# global.columns`, or the ten of CoNLL-U. Multiword and empty-node lines are skipped. A sentence
    without tokens gives no row; one without sent_id has a null sentence_id. Directories are read through, in path order;
    .zstd files are skipped. jos_labels="en" translates dependency labels, jos_tags="sl" positional tags. sent_ix rises along a file but has gaps: it is
    the start of the scan's block and the place of the sentence in its task, so no row is moved to number it. Files with
    LF are split over tasks at empty lines; one with CRLF has none that the scan knows, so each of its blocks is one record.
    """
    names = input_files(spark, paths)
    files = file_numbers(spark, names) if files is None else files
    raw = spark.read.option("lineSep", "\n\n").text(list(map(unquote, names)))
    raw = raw.select(F.col("_metadata.file_path").alias("path"), F.coalesce("_metadata.file_block_start", F.lit(0)).alias("start"), F.explode(F.split("value", r"\r?\n[ \t]*\r?\n")).alias("value"))
    raw = raw.select("path", (F.shiftleft("start", 23) + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 23) - 1))).alias("sent_ix"), F.split("value", r"\r?\n").alias("said"))
    plain = "ID FORM LEMMA UPOS XPOS FEATS HEAD DEPREL DEPS MISC"
    if any(x.endswith(".conllup") for x in names):
        found = F.array_compact(F.transform("said", lambda x: F.regexp_extract(x, r"^# global\.columns *= *(.+)", 1).alias("names")))
        header = raw.select("path", F.array_max(found).alias("names")).where("names <> ''").groupBy("path").agg(F.first("names").alias("names"))
        raw = raw.join(header, "path", "left")
        columns = F.split(F.coalesce("names", F.lit(plain)), " +")
    else:
        columns = F.array(*map(F.lit, plain.split()))
    rows = raw.withColumn("lines", F.transform(F.filter("said", lambda x: x.rlike(r"^\d+\t")), lambda x: F.split(x, "\t")))
    rows = rows.where(F.size("lines") > 0).withColumn("columns", columns)
    cell = lambda line, name: F.get(line, F.array_position("columns", name).cast("int") - 1)

    def token(line: Column, i: Column) -> Column:
        misc = F.concat(F.lit("|"), F.coalesce(cell(line, "MISC"), F.lit("")), F.lit("|"))
        common = (i + 1, cell(line, "ID"), cell(line, "FORM"), cell(line, "LEMMA"))
        tag = (ud_msd(cell(line, "UPOS"), cell(line, "FEATS")), cell(line, "UPOS")) if ud else positional(cell(line, "XPOS"), jos_tags)
        return _token(*common, *tag, misc.contains("|SpaceAfter=No|"))

    label = lambda x: cell(x, "DEPREL") if ud or jos_labels == "sl" else translate_label(cell(x, "DEPREL"))
    ids = F.concat(F.array(F.lit("0")), F.transform("lines", lambda x: cell(x, "ID")))
    links = let(ids, lambda known: F.transform("lines", lambda x, i: F.struct((F.array_position(known, cell(x, "HEAD")).cast("int") - 1).alias("head"), (i + 1).cast("int").alias("dep"), label(x).alias("label"))))
    said = F.array_max(F.transform("said", lambda x: F.nullif(F.trim(F.regexp_extract(x, r"^# sent_id *= *(.+)", 1)), F.lit(""))))
    few = F.broadcast(files) if len(names) < 100_000 else files
    return Corpus(rows.join(few, "path").select(*KEY, said.alias("sentence_id"), with_root(F.transform("lines", token)).alias("tokens"), links.alias("links")), ud)


TEI_ROW = "path string, sent_ix int, sentence_id string, words array<struct<id:string,form:string,lemma:string,pos:string,msd:string,glue:boolean>>, links array<struct<head:string,dep:string,label:string>>"
TEI_BATCH = 20_000  # sentences, words and links of a batch
XML_ID = "{http://www.w3.org/XML/1998/namespace}id"


@lru_cache(1 << 16)
def _tei_tag(msd: str) -> tuple[str, str]:
    parts = [x.partition("=")[::2] for x in msd.split("|") if "=" in x]
    pos = next((v for k, v in parts if k.lower() == "upostag"), "")
    return pos, "|".join(f"{k}={v}" for k, v in parts if k.lower() != "upostag")


def tei_target(ud: bool, done: list[tuple[str, list[tuple], list[tuple]]]) -> SimpleNamespace:
    """A target for XMLParser that puts (sentence id, words, links) in done as an outermost sentence ends, those inside it after it. w and pc keep their order, which glue needs; nothing else of the document is kept."""
    mark = "ud-syn:" if ud else "jos-syn:"
    kinds, words, links, group, opened, text = {}, [], [], [], [], None

    def start(tag: str, given: dict[str, str]) -> None:
        nonlocal text
        kind, text, get = kinds.get(tag), None, given.get  # the text of an element ends at its first child
        if kind is None:
            kind = kinds[tag] = tag.rpartition("}")[2]
        if kind == "s":
            opened.append([get(XML_ID) or get("id"), len(words), len(links)])
            group.append(opened[-1])
        elif not opened:
            return
        elif kind == "w" or kind == "pc":
            text = []
            pos, msd = _tei_tag(get("msd") or "") if ud else ("", (get("ana") or "")[4:])
            words.append((get(XML_ID) or get("id"), text, get("lemma") if kind == "w" else text, pos, msd, get("join") == "right"))
        elif kind == "link":
            if get("dep"):
                links.append((get("from"), get("dep"), get("afun")))
            elif (said := get("ana") or "").startswith(mark) and len(ends := (get("target") or "").replace("#", "").split()) == 2:
                links.append((*ends, said[len(mark) :]))

    def data(given: str) -> None:
        if text is not None:
            text.append(given)

    def end(tag: str) -> None:
        nonlocal text
        text = None
        if kinds[tag] == "s":
            opened.pop().extend((len(words), len(links)))
            if not opened:
                said = [(i, (form := "".join(x)), form if lemma is x else lemma, pos, msd, glue) for i, x, lemma, pos, msd, glue in words]
                done.extend((name, said[w:w_end], links[x:x_end]) for name, w, x, w_end, x_end in group)
                for kept in (words, links, group):
                    kept.clear()

    return SimpleNamespace(start=start, data=data, end=end)


def tei_sentences(pieces: Iterable[bytes], ud: bool) -> Iterator[tuple[str, list[tuple], list[tuple]]]:
    """(sentence id, words, links) of a TEI document, whose bytes come in pieces of any length; words and links as in TEI_ROW."""
    done: list[tuple[str, list[tuple], list[tuple]]] = []
    parser = ElementTree.XMLParser(target=tei_target(ud, done))
    for piece in pieces:
        parser.feed(piece)
        yield from done
        done.clear()
    parser.close()
    yield from done


def _tei_batch(path: str, first: int, sentences: list[tuple[str, list[tuple], list[tuple]]]) -> pa.RecordBatch:
    def lists(rows: list[list[tuple]], fields: dict[str, pa.DataType]) -> pa.Array:
        columns = list(zip(*chain.from_iterable(rows), strict=True)) or [()] * len(fields)
        inner = pa.StructArray.from_arrays([pa.array(x, kind) for x, kind in zip(columns, fields.values(), strict=True)], list(fields))
        return pa.ListArray.from_arrays(pa.array(accumulate(map(len, rows), initial=0), pa.int32()), inner)

    names, words, links = zip(*sentences, strict=True)
    word = dict.fromkeys(("id", "form", "lemma", "pos", "msd"), pa.string()) | {"glue": pa.bool_()}
    columns = (pa.array([path] * len(names), pa.string()), pa.array(range(first, first + len(names)), pa.int32()), pa.array(names, pa.string()), lists(words, word), lists(links, dict.fromkeys(("head", "dep", "label"), pa.string())))
    return pa.RecordBatch.from_arrays(list(columns), ["path", "sent_ix", "sentence_id", "words", "links"])


def _tei_pieces(spark: SparkSession, names: list[str]) -> DataFrame:
    """(path, value): the bytes of the files, cut before each `</`, those of a file together and in order.

    A well-formed document doesn't end in `</`, so every piece but the first began with it. The scan splits files over
    tasks, so the pieces are gathered by file and sorted, which spills; gzipped files are not split. An empty file has none.
    """
    found = []
    for packed in (True, False):
        if own := [x for x in names if x.endswith(".gz") == packed]:
            scan = spark.read.option("lineSep", "</").text(list(map(unquote, own)))
            place = (F.coalesce("_metadata.file_block_start", F.lit(0)).alias("start"), F.monotonically_increasing_id().alias("at"))
            pieces = scan.select(F.col("_metadata.file_path").alias("path"), *place, F.concat(F.lit("</"), "value").cast("binary").alias("value"))
            found.append((pieces if packed else pieces.repartition("path").sortWithinPartitions("path", "start", "at")).select("path", "value"))
    return found[0] if len(found) == 1 else found[0].union(found[1])


def read_tei(spark: SparkSession, paths: str | list[str], *, ud: bool = True, jos_labels: str = "sl", jos_tags: str = "en", files: DataFrame | None = None) -> Corpus:
    """TEI XML, also gzipped: both link encodings (from/dep/afun, and ana/target), glue from join="right". A link to a word outside its sentence is left out. A document is one task's work, which parses it in pieces and holds a sentence of it. jos_labels="en" translates dependency labels, jos_tags="sl" positional tags."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        for batch in batches:
            ends, begin = pc.run_end_encode(batch["path"]), 0
            for end, path in zip(ends.run_ends.to_pylist(), ends.values.to_pylist(), strict=True):
                yield path, b"".join(batch["value"].slice(begin, end - begin).to_pylist())
                begin = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, own in groupby(runs(batches), itemgetter(0)):
            said = (piece if i else piece[2:] for i, (_, piece) in enumerate(own))
            first, part, size = 0, [], 0
            for sentence in tei_sentences(said, ud):
                part.append(sentence)
                size += 1 + len(sentence[1]) + len(sentence[2])
                if size >= TEI_BATCH:
                    yield _tei_batch(path, first, part)
                    first, part, size = first + len(part), [], 0
            if part:
                yield _tei_batch(path, first, part)

    names = input_files(spark, paths)
    files = file_numbers(spark, names) if files is None else files
    rows = _tei_pieces(spark, names).mapInArrow(run, TEI_ROW).join(F.broadcast(files) if len(names) < 100_000 else files, "path")
    ids = F.concat(F.array("sentence_id"), F.col("words.id"))

    def token(w: Column, i: Column) -> Column:
        before = F.coalesce(F.get(F.col("words.glue"), i - 1), F.lit(False))
        tag = (ud_msd(w["pos"], w["msd"]), w["pos"]) if ud else positional(w["msd"], jos_tags)
        return _token(i + 1, F.substring_index(w["id"], ".", -1), w["form"], w["lemma"], *tag, w["glue"], before, number=_number(w["id"]))

    label = lambda x: x["label"] if jos_labels == "sl" else translate_label(x["label"])
    links = F.transform("links", lambda x: F.struct((F.array_position("ids", x["head"]).cast("int") - 1).alias("head"), (F.array_position("ids", x["dep"]).cast("int") - 1).alias("dep"), label(x).alias("label")))
    return Corpus(rows.withColumn("ids", ids).select(*KEY, "sentence_id", with_root(F.transform("words", token)).alias("tokens"), links.alias("links")), ud)


def read_corpus(spark: SparkSession, paths: str | list[str], **options) -> Corpus:
    """Files and directories of both formats, each file by its suffix: .xml is TEI, .conllu and .conllup are CoNLL-U.

    Files are numbered in path order over both. A file with another suffix raises an error; .zstd files are skipped.
    """
    names = input_files(spark, paths)
    of = {x: x.rpartition(".")[2] for x in names}
    if unknown := [x for x in names if of[x] not in ("xml", "conllu", "conllup")]:
        raise ValueError(f"unknown corpus format: {unknown[:3]}")
    files = file_numbers(spark, names)
    kinds = ((read_tei, [x for x in names if of[x] == "xml"]), (read_conllu, [x for x in names if of[x] != "xml"]))
    read = [reader(spark, list(map(unquote, own)), files=files, **options) for reader, own in kinds if own]
    return read[0] if len(read) == 1 else Corpus(read[0].union(read[1]).sentences, read[0].ud)


UPOS = ("NOUN", "VERB", "ADJ", "ADV", "ADP", "NOUN")


def _pick(values, i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))


def _upos(n: Column) -> Column:
    return _pick(UPOS, n % 6)


def _heap_corpus(sentences: DataFrame) -> Corpus:
    """sentences with `words` array<struct<form,lemma,pos,feats,glue>>: in the order of the words, or from the end where file and sentence number add up to an odd number, the head of word n is word n // 2."""

    def token(words: Column):
        return lambda w, i: _token(i + 1, i + 1, w["form"], w["lemma"], F.concat(w["feats"], F.lit("|POS="), w["pos"]), w["pos"], w["glue"], F.coalesce(F.get(words, i - 1)["glue"], F.lit(False)), number=i + 1)

    mirrored, n = (F.col("file_ix") + F.col("sent_ix")) % 2 == 1, F.size("words")

    def link(w: Column, i: Column) -> Column:
        tok = i + 1
        above = F.shiftright(F.when(mirrored, n - i).otherwise(tok), 1)
        head = F.when(mirrored & (above > 0), n + 1 - above).otherwise(above)
        by_pos = F.when(w["pos"] == "ADV", "advmod").when(w["pos"] == "ADJ", "amod").when(w["pos"] == "ADP", "case").when(w["pos"] == "VERB", "conj").otherwise(_pick(("obj", "obl", "nsubj"), tok % 3))
        return F.struct(head.cast("int").alias("head"), tok.cast("int").alias("dep"), F.when(above == 0, "root").otherwise(by_pos).alias("label"))

    return Corpus(sentences.select(*KEY, "sentence_id", with_root(let(F.col("words"), lambda words: F.transform(words, token(words)))).alias("tokens"), F.transform("words", link).alias("links")))


def documents_corpus(docs: DataFrame) -> Corpus:
    """Plain documents as a treebank by rule: a line with a word is a sentence, and each document is a file. A word that ends in other characters than letters and digits has no space after it."""
    lines = docs.select(F.col("doc_id").alias("file_ix"), F.posexplode(F.split("text", "\n")).alias("sent_ix", "line"))
    forms = F.filter(F.split("line", r"[ \t\r]+"), lambda x: x != "")
    cut = F.transform(forms, lambda x: F.struct(x.alias("form"), F.lower(x).alias("low"), F.lower(F.regexp_replace(x, r"[^\p{L}\p{N}]+$", "")).alias("cut")))
    known = F.transform(cut, lambda x: F.struct(x["form"].alias("form"), F.when(x["cut"] == "", x["low"]).otherwise(x["cut"]).alias("lemma"), (x["cut"] != x["low"]).alias("glue")))

    def word(x: Column, i: Column) -> Column:
        n = F.length(x["lemma"])
        feats = F.concat(F.lit("Case="), _pick(("Nom", "Acc", "Gen"), (i + 1) % 3), F.when(n % 2 == 0, "|Number=Sing").otherwise("|Number=Plur"))
        return F.struct(x["form"].alias("form"), x["lemma"].alias("lemma"), _upos(n).alias("pos"), feats.alias("feats"), x["glue"].alias("glue"))

    named = F.concat_ws(".", F.col("file_ix").cast("string"), F.col("sent_ix").cast("string"))
    return _heap_corpus(lines.select(*KEY, named.alias("sentence_id"), F.transform(known, word).alias("words")).where(F.size("words") > 0))


def orders_corpus(lineitem: DataFrame, part: DataFrame) -> Corpus:
    """Orders as short sentences: a line is a word, its brand the lemma, in several forms and cases; an order has few lines, so a sentence is small."""
    form = F.when(F.col("l_linenumber") % 4 == 0, F.col("p_brand")).when(F.col("l_linenumber") % 4 == 1, F.lower("p_brand")).otherwise(F.concat("p_brand", F.lit("s")))
    case = F.when(F.col("l_returnflag") == "A", "Case=Nom").when(F.col("l_returnflag") == "N", "Case=Acc").otherwise("Case=Gen")
    word = F.struct(form.alias("form"), F.lower("p_brand").alias("lemma"), _upos(F.col("p_size")).alias("pos"), case.alias("feats"), F.lit(False).alias("glue")).alias("w")
    words = lineitem.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("file_ix"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", word).alias("x"))
    grouped = words.groupBy("file_ix").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    return _heap_corpus(grouped.select("file_ix", F.lit(0).alias("sent_ix"), F.col("file_ix").cast("string").alias("sentence_id"), F.col("xs.w").alias("words")))
