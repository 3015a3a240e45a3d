"""Registered query on names in other scripts (T01), with DuckDB SQL that spells them by its own table."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchbook.functions import text as tx
from matchbook.functions.romanise import romanise, unmapped_letters
from matchbook.plans import oracle as O
from matchbook.plans.catalog import register
from matchbook.sources import records as rs

LATIN = "abcdefghijklmnopqrstuvwxyz"
# Each Latin letter of a name becomes one letter of the script; h is the virama in the two abugidas.
SCRIPTS = {
    "cyrillic": "абцдефгхийклмнопжрстувшщюз",
    "greek": "αβψδεφγηιίκλμνοπθρστυξωχύζ",
    "devanagari": "ाबचदेफग्िजकलमनोपखरसतुवशषयझ",
    "tamil": "ாபசடேஞக்ிஜகலமநோபணரஸதுவறஷயழ",
    "full-width": "ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ",
    "han": "一二三四五六七八九十abcdefghijklmnop",
}
# Fixed values, for the oracle alone: the spellings of those letters.
SPELLED = {
    "cyrillic": "a b ts d e f g kh i i k l m n o p zh r s t u v sh shch yu z".split(),
    "greek": "a b ps d e ph g e i i k l m n o p th r s t u x o kh u z".split(),
    "devanagari": "+aa ba ca da +e pha ga + +i ja ka la ma na +o pa kha ra sa ta +u va sha ssa ya jha".split(),
    "tamil": "+aa pa ca tta +ee nya ka + +i ja ka la ma na +oo pa nna ra sa ta +u va rra ssa ya llla".split(),
    "full-width": list(LATIN),
    "han": ["" if x < 10 else LATIN[x - 10] for x in range(26)],
}
NATIVE_SQL = "SELECT entity_id, CASE CAST(substr(entity_id, 4) AS BIGINT) % " + str(len(SCRIPTS)) + " " + " ".join(
    f"WHEN {i} THEN translate(lower(business_name), '{LATIN}', '{letters}')" for i, letters in enumerate(SCRIPTS.values())) \
    + " END AS name FROM {records} WHERE src = 1"


def _spelling(script: str) -> str:
    t = "name"
    for letter, spelling in zip(SCRIPTS[script], SPELLED[script]):
        if letter not in LATIN:
            t = f"replace({t}, '{letter}', '{spelling.replace('+', chr(1))}')"
    return f"regexp_replace({t}, 'a{chr(1)}|{chr(1)}', '', 'g')"


def _romanised(spark, sf):
    names = spark.sql(NATIVE_SQL, records=rs.records(spark, sf))
    return names.select("entity_id", "name", tx.ascii_fold(F.col("name")).alias("folded"),
                        unmapped_letters(romanise(F.col("name"))).alias("n_unmapped"))


register("romanised_names", f"""WITH records AS ({O.records_cte()}), names AS ({NATIVE_SQL.format(records='records')}),
s AS (SELECT *, CAST(substr(entity_id, 4) AS BIGINT) % {len(SCRIPTS)} AS script FROM names)
SELECT entity_id, name, CASE script {' '.join(f"WHEN {i} THEN {_spelling(s)}" for i, s in enumerate(SCRIPTS))} END AS folded,
       CASE script WHEN {list(SCRIPTS).index('han')} THEN len(regexp_extract_all(name, '[{SCRIPTS['han'][:10]}]')) ELSE 0 END::BIGINT AS n_unmapped
FROM s""")(_romanised)
