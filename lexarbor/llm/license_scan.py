"""License scans: known sentences to identifiers, identifier sequences to licences (DataFrame functions only).

A text is parted into pieces at line breaks and marks that may end a sentence. A known sentence is found where its
words are one piece or several pieces in a row, so notices are found as published: wrapped, in comments, or with a colon
inside. A rule is a sequence of sentence identifiers that must occur in this order, others between them allowed. All is
done row by row: nothing is exploded, shuffled or joined, as the two tables are constants of bounded size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

# Sentences of public licence notices, normalised (lower case, runs of other characters than a-z, 0-9 and dots inside numbers as one space).
SENTENCES = {
    "mit.released": "released under the mit license",
    "mit.licensed": "licensed under the mit license",
    "mit.grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit.notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache.licensed": "licensed under the apache license version 2.0",
    "apache.comply": "you may not use this file except in compliance with the license",
    "apache.copy": "you may obtain a copy of the license at",
    "gpl3.work": "this work is licensed under the gnu general public license version 3",
    "gpl.redistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl.hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "bsd.redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd.source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd.binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd.names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "cc.by-nc": "licensed under cc by nc 4.0",
    "cc.by": "licensed under cc by 4.0",
    "cc.by-sa": "licensed under cc by sa 4.0",
    "cc.by.work": "this work is licensed under a creative commons attribution 4.0 international license",
    "cc.by-sa.work": "this work is licensed under a creative commons attribution sharealike 4.0 international license",
    "cc.by-nc.work": "this work is licensed under a creative commons attribution noncommercial 4.0 international license",
    "cc0.waived": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "gpl2.redistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "lgpl2.redistribute": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version",
    "lgpl3.redistribute": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl3.redistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "mpl.subject": "this source code form is subject to the terms of the mozilla public license v 2.0",
    "isc.grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "unlicense.released": "this is free and unencumbered software released into the public domain",
    "bsl.distributed": "distributed under the boost software license version 1.0",
    "epl.available": "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https www eclipse org legal epl 2.0",
    "zlib.claims": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib.grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
}
# Licence, then the sentences in their order. Of a licence any rule is enough.
RULES = (
    ("MIT", ("mit.released",)),
    ("MIT", ("mit.licensed",)),
    ("MIT", ("mit.grant", "mit.notice")),
    ("Apache-2.0", ("apache.licensed",)),
    ("GPL-3.0", ("gpl3.work",)),
    ("GPL-3.0-or-later", ("gpl.redistribute", "gpl.hope")),
    ("BSD-3-Clause", ("bsd.redistribution", "bsd.source", "bsd.binary", "bsd.names")),
    ("BSD-2-Clause", ("bsd.redistribution", "bsd.source", "bsd.binary")),
    ("CC-BY-NC-4.0", ("cc.by-nc",)),
    ("CC-BY-4.0", ("cc.by",)),
    ("CC-BY-SA-4.0", ("cc.by-sa",)),
    ("CC-BY-4.0", ("cc.by.work",)),
    ("CC-BY-SA-4.0", ("cc.by-sa.work",)),
    ("CC-BY-NC-4.0", ("cc.by-nc.work",)),
    ("CC0-1.0", ("cc0.waived",)),
    ("GPL-2.0-or-later", ("gpl2.redistribute", "gpl.hope")),
    ("LGPL-2.1-or-later", ("lgpl2.redistribute", "gpl.hope")),
    ("LGPL-3.0-or-later", ("lgpl3.redistribute", "gpl.hope")),
    ("AGPL-3.0-or-later", ("agpl3.redistribute", "gpl.hope")),
    ("MPL-2.0", ("mpl.subject",)),
    ("ISC", ("isc.grant",)),
    ("Unlicense", ("unlicense.released",)),
    ("BSL-1.0", ("bsl.distributed",)),
    ("EPL-2.0", ("epl.available",)),
    ("Zlib", ("zlib.claims", "zlib.grant")),
)
# Other wordings of known sentences; * stands for a name of 1 to 12 words.
VARIANTS = (
    ("apache.licensed", "licensed under the apache license version 2.0 the license"),
    ("gpl.redistribute", "* is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl2.redistribute", "* is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("lgpl2.redistribute", "* is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version"),
    ("lgpl3.redistribute", "* is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl3.redistribute", "* is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("cc0.waived", "to the extent possible under law * has waived all copyright and related or neighboring rights to this work"),
    ("gpl.hope", "* is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("bsd.names", "neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
)
#: A piece ends at a line break, or at . ! ? ; : before white space or the end; so the dot of "2.0" ends none.
BREAK = r"[.!?;:]+(?=\s|$)|\n"
#: What may open a line of a notice and is no word of it: a comment word or the number of a list, after marks.
OPENING = r"(?m)^([^\p{L}\p{N}\n]*)(?:(?:dnl|rem)[ \t]|\(?(?:[0-9]{1,2}|[a-z])\)[ \t])"
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def pieces(text: Column) -> Column:
    """The words of a text in lower case, a space between two, with | between its pieces and at both ends."""
    broken = F.regexp_replace(F.regexp_replace(F.lower(text), OPENING, "$1\x01"), BREAK, "\x01")
    words = F.regexp_replace(F.regexp_replace(broken, r"[^a-z0-9.\x01]+|\.(?![0-9])", " "), " {2,}", " ")
    return F.concat(F.lit("| "), F.regexp_replace(F.trim(words), r" ?\x01[ \x01]*", " | "), F.lit(" |"))


def _phrase(sentence: str) -> str:
    """A sentence as a regular expression over pieces()."""
    gap = r" (?:\| )?"
    return gap.join(rf"[a-z0-9.]+(?:{gap}[a-z0-9.]+){{0,11}}?" if w == "*" else w.replace(".", r"\.") for w in sentence.split())


def _telling(sentences: list[str]) -> list[str]:
    """Long words of which each sentence has one or more."""
    left, out = [{w for w in s.split() if w != "*" and len(w) >= min(7, max(len(x) for x in s.split() if x != "*"))} for s in sentences], []
    while left:
        out.append(max(sorted(set().union(*left)), key=lambda w: (sum(w in s for s in left), len(w))))
        left = [s for s in left if out[-1] not in s]
    return out


def sentence_ids(text: Column, sentences: dict[str, str], variants=()) -> Column:
    """The known sentences of a text as indexes into `sentences`, in order; array<int>.

    They may share pieces; of those that start at the same place the longest counts. Only a text with one of the
    words that _telling() takes from the sentences is looked into.
    """
    at = {name: i for i, name in enumerate(sentences, 1)}
    known = [(s, at[n]) for n, s in (*sentences.items(), *variants) if s and n in at]
    if not known:
        return F.when(text.isNotNull(), F.array().cast("array<int>"))
    known = sorted(((_phrase(s), i) for s, i in known), key=lambda x: -len(x[0].split()))
    likely = F.lower(text).rlike("|".join(w.replace(".", r"\.") for w in _telling([s for s in (*sentences.values(), *(s for n, s in variants if n in at)) if s])))
    found = F.regexp_extract_all(pieces(text), F.lit(rf"(?<=\| )(?=({'|'.join(p for p, _ in known)}) +\|)"), F.lit(1))
    which = lambda said: F.coalesce(*(F.when(said.rlike(f"^(?:{p})$"), F.lit(i)) for p, i in known))
    return F.when(likely, F.transform(found, which)).otherwise(F.array().cast("array<int>"))


def part_of(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
    """Whether a longer rule b has the sentences of a in their order."""
    rest = iter(b)
    return len(a) < len(b) and all(x in rest for x in a)


def matched_licenses(ids: Column, sentences: dict[str, str], rules) -> Column:
    """The licences whose rules match the identifier sequence, in the order of the rules, each once.

    A rule that is part of a longer one (its sentences are among the longer one's, in their order) gives way where that
    one matches.
    """
    at = {name: i for i, name in enumerate(sentences, 1)}
    line = F.concat(F.lit(","), F.array_join(ids.cast("array<string>"), ","), F.lit(","))
    line = F.replace(line, F.lit(","), F.lit(",,"))
    said = lambda names: line.like("%" + "%".join(f",{at[n]}," for n in names) + "%")
    longer = lambda names: [said(b) for _, b in rules if part_of(names, b)]
    found = [F.when(reduce(lambda x, y: x & ~y, longer(names), said(names)), F.lit(licence)) for licence, names in rules]
    return F.array_distinct(F.array_compact(F.array(*found)))


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] | None = None, rules=RULES, variants=VARIANTS) -> DataFrame:
    """(doc_id, sentence_ids, licenses): a row per input row. Null and empty texts have neither; repeated sentences repeat in sentence_ids.

    variants are more wordings, (name in sentences, wording); those of other names are left out.
    """
    sentences = SENTENCES if sentences is None else sentences
    ids = F.coalesce(sentence_ids(F.col(text_col), sentences, variants), F.array().cast("array<int>"))
    return docs.select(F.col(id_col).alias("doc_id"), ids.alias("sentence_ids")).select("doc_id", "sentence_ids", matched_licenses(F.col("sentence_ids"), sentences, rules).alias("licenses"))


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    names = F.array_join(F.transform("sentence_ids", lambda i: F.element_at(F.array(*map(F.lit, SENTENCES)), i)), ",")
    return found.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), names.alias("sentences"), F.array_join("licenses", ",").alias("licenses"))


def _op8_sql() -> str:
    """The same tables in SQL: sentences are looked up in a joined table, and a rule is a chain of positions."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({i}, {quote(n)}, {quote(s)})" for i, (n, s) in enumerate(SENTENCES.items(), 1))
    rules = ", ".join(f"({i}, {quote(licence)}, {quote('%' + '%'.join(f',{n},' for n in names) + '%')})" for i, (licence, names) in enumerate(RULES))
    longer = ", ".join(f"({i}, {quote('%' + '%'.join(f',{n},' for n in b) + '%')})" for i, (_, a) in enumerate(RULES) for _, b in RULES if part_of(a, b))
    return rf"""
WITH known(idx, name, sentence) AS (VALUES {known}),
rules(n, licence, pattern) AS (VALUES {rules}),
longer(n, pattern) AS (VALUES {longer}),
parts AS (
    SELECT doc_id, unnest(p) AS part, generate_subscripts(p, 1) AS pos
    FROM (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '[.!?;:]+(\s|$)|\n', chr(1), 'g'), chr(1)) AS p FROM documents)),
said AS (
    SELECT doc_id, pos, trim(regexp_replace(regexp_replace(lower(part), '[^a-z0-9.]+', ' ', 'g'), '\.( |$)', ' ', 'g')) AS sentence
    FROM parts),
hits AS (SELECT doc_id, count(*) AS n, string_agg(name, ',' ORDER BY pos) AS names FROM said JOIN known USING (sentence) GROUP BY doc_id),
licensed AS (
    SELECT doc_id, string_agg(licence, ',' ORDER BY n) AS licenses
    FROM (SELECT h.doc_id, r.licence, min(r.n) AS n FROM hits h JOIN rules r ON ',,' || replace(h.names, ',', ',,') || ',,' LIKE r.pattern
          WHERE NOT EXISTS (SELECT 1 FROM longer x WHERE x.n = r.n AND ',,' || replace(h.names, ',', ',,') || ',,' LIKE x.pattern) GROUP BY 1, 2) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(h.n, 0) AS BIGINT) AS n_sentences, coalesce(h.names, '') AS sentences, coalesce(l.licenses, '') AS licenses
FROM documents d LEFT JOIN hits h USING (doc_id) LEFT JOIN licensed l USING (doc_id)
"""


OP8_SQL = _op8_sql()
