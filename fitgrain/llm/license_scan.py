"""Licence statements in text, by Dice coefficient over word bigrams.

Lines, paragraphs and the whole text are normalised and compared with normalised
templates, and so are runs of words inside them. A Dice coefficient of t or more bounds the
number of bigrams of a segment by that of the template, and a text needs so many of a
template's bigrams to match anywhere: texts without them are settled by one look at all
their bigrams. Column expressions only.
"""

from __future__ import annotations

import re
from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Common licence statements.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0."],
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the "
        "Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the "
        "terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version.",
    ],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 License."],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met."
    ],
}
LEAST_DICE = 0.8
#: Runs of words that are like a template, the likest first when sorted.
RUNS = "array<struct<minus:double,length:int,first:int,name:string,template:int>>"
SEGMENTS = RUNS.replace(">>", ",segment:string>>")


def normal_words(text: str) -> list[str]:
    return re.sub(r"[^0-9a-z]+", " ", text.lower()).split()


def bigrams(found: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(found, found[1:])})


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^0-9a-z]+"), "")


def _bigrams(found: Column) -> Column:
    """The bigram at each word but the last."""
    return F.zip_with(
        F.slice(found, F.lit(1), F.greatest(F.size(found) - 1, F.lit(0))),
        F.slice(found, 2, 1 << 30),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )


def _windows(
    all_grams: Column,
    k: int,
    name: str,
    grams: list[str],
    fewest: int,
    most: int,
    least: float,
) -> Column:
    """Runs of at most ``most`` bigrams that are like a template, the best from each start.

    A run that is like it and can't be cut begins and ends with one of its bigrams and has
    ``fewest`` of them, so only such runs are scored.
    """
    wanted = F.lit(grams)

    def from_start(p: Column) -> Column:
        def scored(run: Column) -> Column:
            # A bigram adds to the size where it is first.
            steps = F.transform(
                run,
                lambda g, i: F.struct(
                    (F.array_position(run, g) == i + 1).alias("new"),
                    F.array_contains(wanted, g).alias("hit"),
                ),
            )
            zero = F.struct(
                *(F.lit(0).alias(x) for x in ("i", "n", "common")),
                F.lit(0.0).alias("dice"),
                F.lit(0).alias("length"),
            )

            def step(acc: Column, x: Column) -> Column:
                n = acc["n"] + x["new"].cast("int")
                common = acc["common"] + (x["new"] & x["hit"]).cast("int")
                dice = 2.0 * common / (n + F.lit(len(grams)))
                i = acc["i"] + 1
                return F.struct(
                    i.alias("i"),
                    n.alias("n"),
                    common.alias("common"),
                    F.greatest(dice, acc["dice"]).alias("dice"),
                    F.when(dice > acc["dice"], i).otherwise(acc["length"]).alias("length"),
                )

            return F.aggregate(steps, zero, step)

        return _let(
            _let(F.slice(all_grams, p + 1, most), scored),
            lambda best: F.struct(
                (-best["dice"]).alias("minus"),
                best["length"].alias("length"),
                p.alias("first"),
                F.lit(name).alias("name"),
                F.lit(k).alias("template"),
            ),
        )

    places = F.filter(
        F.transform(all_grams, lambda g, i: F.when(F.array_contains(wanted, g), i)), F.isnotnull
    )
    return _let(
        places,
        lambda at: F.filter(
            F.transform(
                F.filter(at, lambda p, i: F.get(at, i + (fewest - 1)) - p < F.lit(most)), from_start
            ),
            lambda x: -x["minus"] >= F.lit(least),
        ),
    )


def _apart(x: Column, y: Column) -> Column:
    """Whether two runs of words have none in common; a run has ``length + 1`` words."""
    return (x["first"] + x["length"] < y["first"]) | (y["first"] + y["length"] < x["first"])


def scan_licenses(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    templates: dict[str, list[str]] | None = None,
    least: float = LEAST_DICE,
) -> DataFrame:
    """``id, license, dice, n_matches, matched`` of each document.

    ``matched`` has every segment with a coefficient of ``least`` or more, with the best
    template's name; ``license`` and ``dice`` are of the best of them (ties: the first
    name), null and 0 without a match; ``n_matches`` is their number. Segments are the
    lines, the paragraphs of two lines or more, and a text of several paragraphs; a line
    without a letter or digit parts paragraphs. After them come statements inside longer
    segments: runs of words anywhere in the text, no larger than a whole segment could be
    with repeated bigrams counted, that don't overlap a better run, nor a matched segment
    of the same template.

    Null and empty texts match nothing. Repeated rows and null ids are scanned like any
    others. Other columns are not read. An empty table gives no rows.
    """
    bodies = [
        (name, normal_words(body))
        for name, bodies in sorted((templates or TEMPLATES).items())
        for body in bodies
    ]
    listed = [(name, bigrams(body)) for name, body in bodies]
    # Bounds on the bigrams of a segment; the sums may be a little off a whole number.
    low = [ceil(len(b) * least / (2 - least) - 1e-9) for _, b in listed]
    high = [floor(len(b) * (2 - least) / least + 1e-9) for _, b in listed]
    longest = [floor((len(body) - 1) * (2 - least) / least + 1e-9) for _, body in bodies]
    fewest = [max(1, n) for n in low]
    stems = sorted({g for _, b in listed for g in b})

    def against(found: Column, k: int) -> Column:
        name, grams = listed[k]
        n = F.size(found)
        common = F.size(F.array_intersect(found, F.lit(grams)))
        dice = F.when(
            (n > 0) & n.between(low[k], high[k]), 2.0 * common / (n + F.lit(len(grams)))
        ).otherwise(F.lit(0.0))
        return F.struct(
            (-dice).alias("minus"), F.lit(name).alias("name"), F.lit(k).alias("template")
        )

    def matches(parts: Column) -> Column:
        """Those of ``parts`` that match as a whole; together they have all words in order."""

        def before(i: Column) -> Column:
            earlier = F.slice(parts, F.lit(1), i)
            return F.aggregate(earlier, F.lit(0), lambda n, x: n + F.size(x["words"]))

        def best(part: Column, i: Column) -> Column:
            top = _let(
                F.array_distinct(_bigrams(part["words"])),
                lambda found: F.array_min(
                    F.array(*(against(found, k) for k in range(len(listed))))
                ),
            )
            return F.struct(top.alias("top"), part.alias("part"), i.alias("i"))

        like = F.filter(
            F.transform(parts, best),
            lambda x: (-x["top"]["minus"] >= F.lit(least)) & (x["top"]["minus"] < 0),
        )
        return F.transform(
            like,
            lambda x: F.struct(
                x["top"]["minus"].alias("minus"),
                (F.size(x["part"]["words"]) - 1).alias("length"),
                before(x["i"]).alias("first"),
                x["top"]["name"].alias("name"),
                x["top"]["template"].alias("template"),
                x["part"]["segment"].alias("segment"),
            ),
        )

    def parts(segments: Column) -> Column:
        return F.transform(
            segments, lambda s: F.struct(s.alias("segment"), _words(s).alias("words"))
        )

    def whole(body: Column) -> Column:
        lines = _let(parts(F.split(body, "\n")), matches)
        blocks = _let(
            parts(F.split(body, r"\n[^\p{L}\p{N}]*\n")),
            lambda blocks: F.concat(
                F.filter(matches(blocks), lambda x: F.contains(x["segment"], F.lit("\n"))),
                F.when(F.size(blocks) > 1, matches(parts(F.array(body)))).otherwise(
                    F.array().cast(SEGMENTS)
                ),
            ),
        )
        return F.concat(lines, blocks)

    def inside(
        body: Column, words: Column, grams: Column, enough: list[Column], segments: Column
    ) -> Column:
        """The runs of words that no matched segment has."""
        runs = F.flatten(
            F.array(
                *(
                    F.when(
                        enough[k],
                        _windows(grams, k, *listed[k], fewest[k], longest[k], least),
                    ).otherwise(F.array().cast(RUNS))
                    for k in range(len(listed))
                )
            )
        )
        chosen = F.aggregate(
            F.sort_array(runs),
            F.array().cast(RUNS),
            lambda kept, x: F.when(
                F.forall(kept, lambda y: _apart(x, y)), F.concat(kept, F.array(x))
            ).otherwise(kept),
        )
        new = F.filter(
            chosen,
            lambda x: F.forall(
                segments, lambda s: (s["template"] != x["template"]) | _apart(s, x)
            ),
        )

        def as_written(x: Column) -> Column:
            run = F.slice(words, x["first"] + 1, x["length"] + 1)
            pattern = F.concat(F.lit("(?i)(?<![0-9a-z])"), F.array_join(run, "[^0-9a-z]+"))
            return F.coalesce(F.regexp_substr(body, pattern), F.array_join(run, " "))

        return F.transform(
            F.array_sort(new, lambda x, y: x["first"] - y["first"]),
            lambda x: x.withField("segment", as_written(x)),
        )

    none = F.array().cast("array<struct<dice:double,license:string,segment:string>>")

    def found(body: Column) -> Column:
        def of_words(words: Column) -> Column:
            return _let(_bigrams(words), lambda grams: of_grams(words, grams))

        def of_grams(words: Column, grams: Column) -> Column:
            return _let(
                F.array_intersect(grams, F.lit(stems)), lambda known: of_known(words, grams, known)
            )

        def of_known(words: Column, grams: Column, known: Column) -> Column:
            enough = [
                F.size(F.array_intersect(known, F.lit(b))) >= F.lit(n)
                for (_, b), n in zip(listed, fewest)
            ]
            both = _let(
                whole(body),
                lambda segments: F.concat(segments, inside(body, words, grams, enough, segments)),
            )
            named = F.transform(
                both,
                lambda x: F.struct(
                    (-x["minus"]).alias("dice"), x["name"].alias("license"), x["segment"]
                ),
            )
            any_enough = enough[0]
            for x in enough[1:]:
                any_enough = any_enough | x
            return F.when((F.size(known) >= F.lit(min(fewest))) & any_enough, named).otherwise(none)

        return _let(_words(body), of_words)

    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    out = docs.select(F.col(id).alias("id"), _let(body, found).alias("matched"))
    top = F.array_min(
        F.transform(
            "matched", lambda x: F.struct((-x["dice"]).alias("minus"), x["license"].alias("name"))
        )
    )
    return out.select(
        F.col("id").alias(id),
        top["name"].alias("license"),
        F.coalesce(-top["minus"], F.lit(0.0)).alias("dice"),
        F.size("matched").cast("long").alias("n_matches"),
        "matched",
    )
