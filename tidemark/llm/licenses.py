"""License scans by ordered signature rules.

A text is lower-cased (A to Z) and every run of other characters than digits, a to z
and non-ASCII ones becomes one blank, so rules are regexes over blank-separated words.
A rule is tried only where its keyword stands as a word, or joined to a version as in
gplv2. Detections are resolved by interval
containment: one that lies within another of at least its priority is suppressed. All
of it is Spark expressions on the row; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Fixed values: (label, keyword, priority, regex); the keyword is a word of every match, or one of JOINED with its version. Priority 3 is a license's own text or
# its identifier, 2 its full name, 1 a mention. `#` stands for a version number in
# words, as "2 0" or "3".
_HAND = [
    ("spdx", "spdx", 1, "spdx license identifier"),
    ("apache-2.0", "apache", 3, "licensed under the apache license version 2 0"),
    ("apache-2.0", "apache", 3, "spdx license identifier apache 2 0"),
    ("apache-2.0", "apache", 2, "apache (?:software )?license (?:version |v)?2(?: 0)?"),
    ("apache-1.1", "apache", 2, "apache (?:software )?license (?:version |v)?1 1"),
    ("apache", "apache", 1, "apache (?:software )?licen[cs]e"),
    ("mit", "permission", 3, "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "mit", 3, "spdx license identifier mit"),
    ("mit", "mit", 2, "(?:licensed )?under the (?:terms of the )?mit licen[cs]e"),
    ("mit", "mit", 1, "mit licen[cs]e"),
    ("mit", "expat", 1, "expat licen[cs]e"),
    ("isc", "permission", 3, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "isc", 1, "isc licen[cs]e"),
    ("bsd", "redistribution", 3, "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "neither", 3, "neither the name of (?:the )?[^ ]+(?: [^ ]+){0,8} nor the names of its contributors may be used to endorse or promote"),
    ("bsd-4-clause", "advertising", 3, "all advertising materials mentioning features or use of this software must display"),
    ("bsd-2-clause", "bsd", 2, "(?:simplified|2 clause|two clause|freebsd) bsd(?: licen[cs]e)?"),
    ("bsd-3-clause", "bsd", 2, "(?:modified|new|revised|3 clause|three clause) bsd(?: licen[cs]e)?"),
    ("bsd-2-clause", "bsd", 2, "bsd (?:2|two) clause"),
    ("bsd-3-clause", "bsd", 2, "bsd (?:3|three) clause"),
    ("bsd-4-clause", "bsd", 2, "(?:original|4 clause|four clause) bsd(?: licen[cs]e)?"),
    ("bsd", "bsd", 1, "bsd(?: style)? licen[cs]e"),
    ("gpl", "gnu", 3, "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "lesser", 2, "gnu lesser general public license(?: (?:version|v) ?#)?"),
    ("lgpl", "library", 2, "gnu library general public license(?: (?:version|v) ?#)?"),
    ("agpl", "affero", 2, "(?:gnu )?affero general public license(?: (?:version|v) ?#)?"),
    ("gpl", "gnu", 2, "gnu general public license(?: (?:version|v) ?#)?"),
    ("gpl-or-later", "later", 3, "either version # of the license or at your option any later version"),
    ("gpl-1.0", "gpl", 2, "gpl ?v?1(?: 0)?"),
    ("gpl-2.0", "gpl", 2, "gpl ?v?2(?: 0)?"),
    ("gpl-3.0", "gpl", 2, "gpl ?v?3(?: 0)?"),
    ("gpl", "gpl", 1, "(?:gnu )?gpl"),
    ("lgpl-2.1", "lgpl", 2, "lgpl ?v?2 1"),
    ("lgpl-3.0", "lgpl", 2, "lgpl ?v?3(?: 0)?"),
    ("lgpl", "lgpl", 1, "(?:gnu )?lgpl"),
    ("agpl-3.0", "agpl", 2, "agpl ?v?3(?: 0)?"),
    ("agpl", "agpl", 1, "(?:gnu )?agpl"),
    ("gfdl", "documentation", 2, "gnu free documentation license"),
    ("gfdl", "gfdl", 1, "gfdl"),
    ("mpl-2.0", "mozilla", 3, "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl", "mozilla", 2, "mozilla public license(?: (?:version|v) ?#)?"),
    ("mpl", "mpl", 1, "mpl(?: ?#)"),
    ("epl", "eclipse", 2, "eclipse public license(?: (?:version|v) ?#)?"),
    ("edl", "eclipse", 2, "eclipse distribution license"),
    ("cddl", "cddl", 1, "cddl"),
    ("cddl", "development", 2, "common development and distribution license"),
    ("cpl", "common", 2, "common public license"),
    ("eupl", "eupl", 1, "eupl"),
    ("eupl", "european", 2, "european union public licen[cs]e"),
    ("zlib", "zlib", 1, "zlib(?: libpng)? licen[cs]e"),
    ("zlib", "altered", 3, "altered source versions must be plainly marked as such"),
    ("boost", "boost", 2, "boost software license"),
    ("unlicense", "unencumbered", 3, "this is free and unencumbered software released into the public domain"),
    ("unlicense", "unlicense", 1, "unlicense"),
    ("wtfpl", "wtfpl", 1, "wtfpl"),
    ("artistic", "artistic", 2, "artistic license(?: #)?"),
    ("psf", "python", 2, "python software foundation license"),
    ("php", "php", 2, "php license"),
    ("openssl", "openssl", 2, "openssl license"),
    ("curl", "curl", 1, "curl license"),
    ("ofl", "ofl", 1, "sil ofl"),
    ("ofl", "font", 2, "(?:sil )?open font license"),
    ("odbl", "database", 2, "open (?:data commons open )?database license"),
    ("odc-by", "attribution", 2, "open data commons attribution license"),
    ("cc0", "cc0", 2, "cc0(?: 1 0)?(?: universal)?"),
    ("cc", "commons", 1, "creative commons"),
    ("public-domain", "domain", 2, "(?:released |placed |dedicated )?(?:in|into|to) the public domain"),
    ("public-domain", "domain", 1, "public domain"),
    ("copyright", "copyright", 2, "copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})*"),
    ("copyright", "copyright", 1, "copyright"),
    ("warranty", "warranty", 2, "without (?:any )?warranty of any kind"),
    ("warranty", "warranties", 2, "without (?:any )?warranties (?:of any kind|or conditions of any kind)"),
    ("warranty", "provided", 2, "(?:is )?provided as is"),
    ("proprietary", "proprietary", 2, "proprietary and confidential"),
    ("proprietary", "confidential", 1, "confidential and proprietary"),
    ("proprietary", "eula", 1, "eula"),
    ("proprietary", "end", 2, "end user licen[cs]e agreement"),
    ("proprietary", "unauthorized", 2, "unauthorized (?:copying|reproduction)(?: or distribution)?"),
    ("proprietary", "unauthorised", 2, "unauthorised (?:copying|reproduction)(?: or distribution)?"),
    ("noncommercial", "commercial", 1, "non commercial use only"),
    ("noncommercial", "noncommercial", 1, "noncommercial use only"),
    ("terms", "terms", 1, "terms of (?:use|service)"),
    ("permission", "permission", 1, "used with permission"),
    ("no-license", "license", 1, "no license(?: is)? granted"),
    ("reserved", "reserved", 2, "some rights reserved"),
]
# The Creative Commons family: abbreviations, names and ways to write them.
_CC = {"by": "attribution", "by sa": "attribution share ?alike", "by nd": "attribution no ?deriv(?:ative)?s", "by nc": "attribution non ?commercial", "by nc sa": "attribution non ?commercial share ?alike", "by nc nd": "attribution non ?commercial no ?deriv(?:ative)?s"}
_CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
_SPDX = (
    "0bsd afl-3.0 apsl-2.0 artistic-1.0 artistic-2.0 bsl-1.0 bsd-1-clause bsd-2-clause bsd-3-clause bsd-4-clause cc0-1.0 cddl-1.0 cddl-1.1 cecill-2.1 cpl-1.0 ecl-2.0 "
    "epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 gpl-1.0-only gpl-2.0-only gpl-2.0-or-later gpl-3.0-only gpl-3.0-or-later agpl-3.0-only agpl-3.0-or-later lgpl-2.0-only lgpl-2.1-only "
    "lgpl-2.1-or-later lgpl-3.0-only lgpl-3.0-or-later ijg ipl-1.0 isc lppl-1.3c mit-0 mpl-1.0 mpl-1.1 mpl-2.0 ms-pl ms-rl mulanpsl-2.0 ncsa nposl-3.0 ofl-1.1 openssl osl-3.0 "
    "php-3.01 postgresql psf-2.0 python-2.0 qpl-1.0 sissl sleepycat unicode-dfs-2016 unlicense upl-1.0 vim w3c wtfpl x11 zlib zpl-2.1"
).split()


def _common(word: str) -> int:
    """Words that a keyword had better not be come last."""
    return word in ("by", "all", "public", "rights")


def _rules() -> list[tuple[str, str, int, str]]:
    out = [(label, key, priority, rx.replace("#", "[0-9]+(?: [0-9]+)?")) for label, key, priority, rx in _HAND]
    out += [(label, min(phrase.split(), key=_common), 2, phrase) for phrase, label in BASE.items()]
    for short, name in _CC.items():
        label = "cc-" + short.replace(" ", "-")
        out.append((label, "cc", 2, f"cc {short}"))
        out.append((label, "commons", 2, f"creative commons {name}"))
        for v in _CC_VERSIONS:
            number = v.replace(" ", ".")
            out.append((f"{label}-{number}", "cc", 3, f"cc {short} {v}"))
            out.append((f"{label}-{number}", "commons", 3, f"creative commons {name} (?:(?:international|unported|generic) )?(?:licen[cs]e )?{v}"))
    for name in _SPDX:
        words = name.replace("-", " ").replace(".", " ")
        out.append((name, words.split()[0], 3, f"spdx license identifier {words}"))
        if len(words.split()) > 2:
            out.append((name, words.split()[0], 3, words))
    return out


#: In order: of detections of equal place and priority the earlier rule's stands.
RULES = _rules()


def normalized(text: str = "text") -> Column:
    """The text's words in lower case, one blank around each; one blank if none."""
    letters = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(F.concat(F.lit(" "), letters, F.lit(" ")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")


def _blanks(text: str) -> str:
    return f"(length({text}) - length(replace({text}, ' ', '')))"


#: Keywords that rules also match joined to a version.
JOINED = ("agpl", "gpl", "lgpl", "mpl")

# A rule's matches: the pieces between them give their places, in characters.
_DETECTIONS = r"""
flatten(transform(flatten(transform(__keys, k -> __rules[k])), r ->
  transform(array(named_struct('p', split(__words, concat('(?<= )', r.rx, '(?= )'), -1), 'm', regexp_extract_all(__words, concat('(?<= )', r.rx, '(?= )'), 0))), x ->
    aggregate(sequence(0, size(x.m)), named_struct('at', 0, 'out', cast(array() as array<struct<a:int,b:int,p:int,n:int,label:string>>)),
      (s, i) -> if(i = size(x.m), s, named_struct(
        'at', s.at + length(x.p[i]) + length(x.m[i]),
        'out', array_append(s.out, named_struct('a', s.at + length(x.p[i]), 'b', s.at + length(x.p[i]) + length(x.m[i]), 'p', r.priority, 'n', r.n, 'label', r.label)))),
      s -> s.out))[0]))
"""
# Sorted by start, longest first, then priority and rule: what a detection lies within
# comes before it, so the furthest end so far of each priority decides.
_SUPPRESSED = """
aggregate(transform(array_sort(transform(__all, d -> named_struct('a', d.a, 'e', -d.b, 'q', -d.p, 'n', d.n, 'label', d.label))), d -> d),
  named_struct('ends', array(-1, -1, -1, -1), 'out', cast(array() as array<struct<a:int,b:int,p:int,label:string>>)),
  (s, d) -> if(array_max(slice(s.ends, 1 - d.q, 4 + d.q)) >= -d.e, s, named_struct(
      'ends', transform(s.ends, (x, i) -> if(i = -d.q, greatest(x, -d.e), x)),
      'out', array_append(s.out, named_struct('a', d.a, 'b', -d.e, 'p', -d.q, 'label', d.label)))),
  s -> s.out)
"""


def scan(docs: DataFrame, rules: list[tuple[str, str, int, str]] | None = None) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_words, the base phrases' n_base, first_word,
    last_word and base_labels, the rules' labels, score, and detections (the first
    character and the end in the normalised text, priority, label).

    base_labels and labels are distinct, sorted and comma-joined, labels holding the
    base ones too. score is 1 for a text that any license text or identifier covers,
    2/3 for a name, 1/3 for a mention, else 0. Null and empty texts have no words. A
    whole text is one row's work; rules are tried only where their keyword occurs."""
    rules = RULES if rules is None else rules
    by_key: dict[str, list[Column]] = {}
    for i, (label, key, priority, rx) in enumerate(rules):
        by_key.setdefault(key, []).append(F.struct(F.lit(i).alias("n"), F.lit(label).alias("label"), F.lit(priority).alias("priority"), F.lit(rx).alias("rx")))
    table = F.create_map(*[x for key, group in by_key.items() for x in (F.lit(key), F.array(*group))])
    base = "(?<= )(?:" + "|".join(BASE) + ")(?= )"
    words = docs.select("doc_id", normalized().alias("__words"))
    based = F.lit(False)
    for phrase in BASE:
        based = based | F.contains("__words", F.lit(f" {phrase} "))
    found = words.withColumn("__pieces", F.when(based, F.split("__words", base, -1)))
    found = found.withColumn("__base", F.when(based, F.expr(f"regexp_extract_all(__words, '{base}', 0)")).otherwise(F.expr("cast(array() as array<string>)")))
    near = F.lit(False)
    for key in JOINED:
        near = near | F.contains("__words", F.lit(f" {key}"))
    joined = F.when(near, F.expr(f"regexp_extract_all(__words, '(?<= )({'|'.join(JOINED)})v?[0-9]+(?= )', 1)")).otherwise(F.expr("cast(array() as array<string>)"))
    present = F.array_intersect(F.concat(F.split("__words", " "), joined), F.array(*[F.lit(key) for key in by_key]))
    found = found.withColumn("__keys", present).withColumn("__rules", F.when(F.size("__keys") > 0, table))
    found = found.withColumn("__all", F.expr(f"if(__rules is null, null, {_DETECTIONS})"))
    found = found.withColumn("detections", F.expr(f"if(__all is null, cast(array() as array<struct<a:int,b:int,p:int,label:string>>), {_SUPPRESSED})"))
    n_words = F.expr(f"cast({_blanks('__words')} - 1 as long)")
    base_label = F.create_map(*[F.lit(x) for pair in BASE.items() for x in pair])
    found = found.withColumn("__labels", F.array_sort(F.array_distinct(F.transform("__base", lambda x: base_label[x]))))
    last = "try_element_at(__base, -1)"
    return found.select(
        "doc_id",
        n_words.alias("n_words"),
        F.size("__base").cast("long").alias("n_base"),
        F.expr(f"cast({_blanks('__pieces[0]')} - 1 as long)").alias("first_word"),
        F.expr(f"cast({_blanks('__words')} - 1 - ({_blanks('try_element_at(__pieces, -1)')} - 1) - (1 + {_blanks(last)}) as long)").alias("last_word"),
        F.concat_ws(",", "__labels").alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_union("__labels", F.col("detections.label")))).alias("labels"),
        (F.coalesce(F.array_max("detections.p"), F.lit(0)) / 3).cast("double").alias("score"),
        "detections",
    )
