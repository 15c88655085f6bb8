"""License scans by sentence rules: normalised sentences become known identifiers, sequences of which match ordered rules.

The known sentences are a fixed small map in the plan; a text is only cut into sentences if it holds one of
the words of which every known sentence has at least one, so nothing is missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Identifiers and texts of licence sentences (public licence texts and usual notices).
SENTENCES = (
    ("mit-released", "Released under the MIT License"),
    ("mit-licensed", "Licensed under the MIT License"),
    ("mit-title", "MIT License"),
    ("mit-the-title", "The MIT License (MIT)"),
    ("mit-grant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions'),
    ("mit-condition", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("as-is", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT'),
    ("apache-licensed", "Licensed under the Apache License, Version 2.0"),
    ("apache-notice", 'Licensed under the Apache License, Version 2.0 (the "License")'),
    ("apache-compliance", "you may not use this file except in compliance with the License"),
    ("apache-copy", "You may obtain a copy of the License at"),
    ("apache-title", "Apache License"),
    ("gpl3-work", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl3-licensed", "Licensed under the GNU General Public License, version 3"),
    ("gpl-free", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl2-free", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("gpl-hope", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"),
    ("lgpl-free", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("bsd-redistribution", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd-endorse", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("ccbync-licensed", "Licensed under CC BY-NC 4.0"),
    ("ccby-licensed", "Licensed under CC BY 4.0"),
    ("ccbysa-licensed", "Licensed under CC BY-SA 4.0"),
    ("ccby-work", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("ccbysa-work", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("ccbync-work", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc0-dedicated", "This work is dedicated to the public domain under the Creative Commons CC0 license"),
    ("mpl-subject", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("reserved", "All rights reserved under copyright"),
    ("apache-version", "Version 2.0, January 2004"),
    ("apache-basis", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied'),
    ("apache-language", "See the License for the specific language governing permissions and limitations under the License"),
    ("apache-terms", "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("apache-grant", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form"),
    ("agpl-free", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("lgpl21-free", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    ("lgpl3-free", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version"),
    ("lgpl-hope", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"),
    ("gpl2-only-free", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"),
    ("bsd-advertising", "All advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("bsd-disclaimer", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED'),
    ("isc-permission", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("0bsd-permission", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc-disclaimer", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS'),
    ("zlib-as-is", "This software is provided 'as-is', without any express or implied warranty"),
    ("zlib-permission", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("zlib-origin", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software"),
    ("zlib-altered", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software"),
    ("zlib-notice", "This notice may not be removed or altered from any source distribution"),
    ("bsl-title", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("bsl-distributed", "Distributed under the Boost Software License, Version 1.0"),
    ("bsl-grant", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following'),
    ("epl2-available", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    ("epl1-available", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("mpl-obtain", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0"),
    ("mpl11-subject", 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License'),
    ("artistic-establishes", "This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed"),
    ("postgresql-permission", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies"),
    ("ccbynd-work", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("ccbyncsa-work", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("ccbyncnd-work", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
)

#: (licence, sentence identifiers that must follow each other in this order, others between them allowed).
RULES = (
    ("MIT", ("mit-grant", "mit-condition", "as-is")),
    ("MIT", ("mit-grant", "mit-condition")),
    ("MIT", ("mit-released",)),
    ("MIT", ("mit-licensed",)),
    ("MIT", ("mit-title",)),
    ("MIT", ("mit-the-title",)),
    ("Apache-2.0", ("apache-notice", "apache-compliance")),
    ("Apache-2.0", ("apache-licensed",)),
    ("Apache-2.0", ("apache-notice",)),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-3.0-only", ("gpl3-work",)),
    ("GPL-3.0-only", ("gpl3-licensed",)),
    ("GPL-2.0-or-later", ("gpl2-free",)),
    ("LGPL", ("lgpl-free",)),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("CC-BY-NC-4.0", ("ccbync-licensed",)),
    ("CC-BY-NC-4.0", ("ccbync-work",)),
    ("CC-BY-4.0", ("ccby-licensed",)),
    ("CC-BY-4.0", ("ccby-work",)),
    ("CC-BY-SA-4.0", ("ccbysa-licensed",)),
    ("CC-BY-SA-4.0", ("ccbysa-work",)),
    ("CC0-1.0", ("cc0-dedicated",)),
    ("MPL-2.0", ("mpl-subject",)),
    ("Unlicense", ("unlicense",)),
    ("LicenseRef-all-rights-reserved", ("reserved",)),
    ("Apache-2.0", ("apache-notice", "apache-compliance", "apache-copy", "apache-basis", "apache-language")),
    ("Apache-2.0", ("apache-title", "apache-version", "apache-terms", "apache-grant")),
    ("Apache-2.0", ("apache-title", "apache-version")),
    ("Apache-2.0", ("apache-grant",)),
    ("AGPL-3.0-or-later", ("agpl-free",)),
    ("AGPL-3.0-or-later", ("agpl-free", "gpl-hope")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope")),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope")),
    ("GPL-2.0-only", ("gpl2-only-free",)),
    ("GPL-2.0-only", ("gpl2-only-free", "gpl-hope")),
    ("LGPL-2.1-or-later", ("lgpl21-free",)),
    ("LGPL-2.1-or-later", ("lgpl21-free", "lgpl-hope")),
    ("LGPL-3.0-or-later", ("lgpl3-free",)),
    ("LGPL-3.0-or-later", ("lgpl3-free", "lgpl-hope")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-disclaimer")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-disclaimer")),
    ("BSD-4-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-endorse")),
    ("BSD-4-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-endorse", "bsd-disclaimer")),
    ("ISC", ("isc-permission",)),
    ("ISC", ("isc-permission", "isc-disclaimer")),
    ("0BSD", ("0bsd-permission",)),
    ("0BSD", ("0bsd-permission", "isc-disclaimer")),
    ("Zlib", ("zlib-as-is", "zlib-permission", "zlib-origin", "zlib-altered", "zlib-notice")),
    ("Zlib", ("zlib-permission", "zlib-origin", "zlib-altered")),
    ("BSL-1.0", ("bsl-title", "bsl-grant")),
    ("BSL-1.0", ("bsl-distributed",)),
    ("BSL-1.0", ("bsl-grant",)),
    ("EPL-2.0", ("epl2-available",)),
    ("EPL-1.0", ("epl1-available",)),
    ("MPL-2.0", ("mpl-subject", "mpl-obtain")),
    ("MPL-1.1", ("mpl11-subject",)),
    ("Artistic-2.0", ("artistic-establishes",)),
    ("PostgreSQL", ("postgresql-permission",)),
    ("CC-BY-ND-4.0", ("ccbynd-work",)),
    ("CC-BY-NC-SA-4.0", ("ccbyncsa-work",)),
    ("CC-BY-NC-ND-4.0", ("ccbyncnd-work",)),
)

#: Identifier lines of every licence of the rules.
TAGS = tuple((f"tag-{x.lower()}", x, f"SPDX-License-Identifier: {x}") for x in sorted({name for name, _ in RULES if not name.startswith("LicenseRef")} | {"LGPL-2.1-only", "LGPL-3.0-only", "AGPL-3.0-only"}))
ALL_SENTENCES = SENTENCES + tuple((i, text) for i, _, text in TAGS)
ALL_RULES = RULES + tuple((name, (i,)) for i, name, _ in TAGS)
#: A sequence is cut before each identifier that begins a rule of several; a rule holds within one stretch.
HEADS = tuple(sorted({rule[0] for _, rule in ALL_RULES if len(rule) > 1}))

#: Each known sentence holds one of these (lower case).
MARKS = ("licen", "permission", "warrant", "redistribut", "copyright", "public domain", "misrepresented", "removed or altered", "version 2 0 january 2004", "terms and conditions", "mpl was not", "advertising materials")
#: A piece ends at a line end, or at one of .!?;: before white space or at the end.
BLANK = "[ \\t\\n\\x0B\\f\\r]"
ENDS = "\n+|(?<=[.!?;:])" + BLANK + "+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def within(short: tuple[str, ...], long: tuple[str, ...]) -> bool:
    """Whether ``short`` is a shorter sequence that stands in ``long`` in order."""
    rest = iter(long)
    return len(short) < len(long) and all(x in rest for x in short)


def beaten_by(n: int) -> list[int]:
    """Rules of other licences that hold rule n and more: where one of them matches, n does not count."""
    name, rule = ALL_RULES[n]
    return [m for m, (other, longer) in enumerate(ALL_RULES) if other != name and within(rule, longer)]


def pattern(rule: tuple[str, ...]) -> str:
    """Of a stretch of identifiers between blanks that holds the rule's, in order."""
    return " " + " (.* )?".join(rule) + " "


def normal(sentence: Column) -> Column:
    """ASCII lower case, every stretch of other than ASCII letters and digits one space, trimmed."""
    return F.trim(F.regexp_replace(F.translate(sentence, CAPITALS, CAPITALS.lower()), "[^a-z0-9]+", " "))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, sentence_ids in text order, licences sorted) of every row of ``docs``; empty arrays where nothing is known.

    From the start of each piece the longest known sentence of whole pieces counts, of however many, since a known sentence
    may itself hold end marks and be wrapped at any width. A null or empty text has none, however long a text is all of it is read; other columns are not.
    The identifiers are cut before each that begins a rule of several; a rule matches a stretch that holds its identifiers in its order. Of rules
    of one licence any one that matches counts; a rule whose identifiers are part of a matching longer rule of another licence
    does not. Repeated rows give repeated rows, a null id stays null.
    """
    pairs = [(plain(t), i) for i, t in ALL_SENTENCES]
    table = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    marked = F.lower(text).rlike("|".join(m.replace(" ", "[^a-z0-9]+") for m in MARKS))
    # pieces on a line each; a known sentence may go over lines, and what it holds is looked at as well
    known = "|".join(x.replace(" ", "[ \n]") for x, _ in sorted(pairs, key=lambda p: -len(p[0].split())))
    pieces = F.array_join(F.filter(F.transform(F.split(text, ENDS), normal), lambda s: s != ""), "\n")
    lines = F.when(marked, F.concat(F.lit("\n"), pieces, F.lit("\n")))
    none = F.array().cast("array<string>")
    own = docs.select(F.col("doc_id"), F.coalesce(F.regexp_extract_all(lines, F.lit(f"\n(?=({known})\n)"), F.lit(1)), none).alias("_s"))
    found = own.select("doc_id", F.transform("_s", lambda x: F.element_at(table, F.translate(x, "\n", " "))).alias("sentence_ids"))
    cut = F.transform("sentence_ids", lambda x: F.when(x.isin(*HEADS), F.concat(F.lit("| "), x)).otherwise(x))
    stretches = F.split(F.concat(F.lit(" "), F.array_join(cut, " "), F.lit(" ")), "\\|")

    def names(stretch: Column) -> Column:
        match = [stretch.rlike(pattern(rule)) for _, rule in ALL_RULES]
        hits = []
        for n, (name, _) in enumerate(ALL_RULES):
            counts = match[n]
            for m in beaten_by(n):
                counts = counts & ~match[m]
            hits.append(F.when(counts, F.lit(name)))
        return F.filter(F.array(*hits), lambda x: x.isNotNull())

    licences = F.when(F.size("sentence_ids") > 0, F.sort_array(F.array_distinct(F.flatten(F.transform(stretches, names))))).otherwise(none)
    return found.select("doc_id", "sentence_ids", licences.alias("licences"))


def plain(text: str) -> str:
    """``normal`` of a known text."""
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split())
