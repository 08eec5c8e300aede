"""Licence recognition by sentence rules.

A text is cut into pieces after line feeds and after ``. ! ? ; : )`` before white space.
A known licence sentence is a run of whole pieces without a blank line between, so that
it may be wrapped over lines; the longest that fits at a piece is taken.  Sentences are
compared as their lower-case runs of ASCII letters and digits (with inner dots, as in
``2.0``, and a plus after a digit), so that comment marks without letters are left out (``dnl`` and ``REM`` are
not).  The identifiers of a text, in order, are matched against ordered rules: the first
rule that fits at a place takes its sentences.

Unknown sentences end at ``. ! ? ; :`` , at blank lines and before known sentences; list
numbers and empty pieces are none.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Container, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbits as tb

# Sentences of public licence texts and notices, by identifier.
SENTENCES: list[tuple[str, str]] = [
    ("apache2-line", "Licensed under the Apache License, Version 2.0."),
    ("apache2-grant", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("apache2-comply", "you may not use this file except in compliance with the License."),
    ("apache2-copy", "You may obtain a copy of the License at"),
    ("apache2-warranty", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("apache2-see", "See the License for the specific language governing permissions and limitations under the License."),
    ("mit-line", "Released under the MIT License."),
    ("mit-line", "Licensed under the MIT License."),
    ("mit-line", "This project is licensed under the MIT License."),
    ("mit-title", "The MIT License (MIT)"),
    ("mit-title", "MIT License"),
    ("mit-grant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("mit-notice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit-warranty", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
    ("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-endorse", "Neither the name of <...> nor the names of <...> may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd-endorse", "The name of <...> may not be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd-endorse", "The names of <...> may not be used to endorse or promote products derived from this software without specific prior written permission."),
    ("gpl3-line", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-grant", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl2-grant", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-hope", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("gpl-see", "See the GNU General Public License for more details."),
    ("gpl2-only-grant", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("gpl2-only-grant", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License."),
    ("gpl3-only-grant", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3."),
    ("lgpl3-grant", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl3-grant", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl21-grant", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl-hope", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("lgpl-see", "See the GNU Lesser General Public License for more details."),
    ("agpl3-grant", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("agpl-see", "See the GNU Affero General Public License for more details."),
    ("mpl2-grant", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl2-copy", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("mpl2-copy", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("epl2-grant", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("epl1-grant", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc-grant", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0bsd-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("isc-warranty", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'),
    ("unlicense-free", "This is free and unencumbered software released into the public domain."),
    ("unlicense-anyone", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib-asis", "This software is provided 'as-is', without any express or implied warranty."),
    ("zlib-damages", "In no event will the authors be held liable for any damages arising from the use of this software."),
    ("zlib-grant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("bsl1-grant", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:'),
    ("bsl1-line", "Distributed under the Boost Software License, Version 1.0."),
    ("bsd-advertise", "All advertising materials mentioning features or use of this software must display the following acknowledgement:"),
    ("wtfpl-do", "You just DO WHAT THE FUCK YOU WANT TO."),
    ("ccby4-work", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("ccbysa4-work", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("ccbync4-work", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("ccbyncsa4-work", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("ccbynd4-work", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("ccbyncnd4-work", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("ccbync4-line", "Licensed under CC BY-NC 4.0."),
    ("ccby4-line", "Licensed under CC BY 4.0."),
    ("ccbysa4-line", "Licensed under CC BY-SA 4.0."),
    ("cc0-line", "Dedicated to the public domain under CC0 1.0."),
    ("all-rights", "All rights reserved."),
]

# Fixed values: (licence, restricts use for training, identifiers in order); earlier rules win.
RULES: list[tuple[str, bool, tuple[str, ...]]] = [
    ("Apache-2.0", False, ("apache2-grant", "apache2-comply", "apache2-copy", "apache2-warranty", "apache2-see")),
    ("MIT", False, ("mit-title", "mit-grant", "mit-notice", "mit-warranty")),
    ("MIT", False, ("mit-grant", "mit-notice", "mit-warranty")),
    ("BSD-3-Clause", False, ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-4-Clause", False, ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertise")),
    ("BSD-2-Clause", False, ("bsd-grant", "bsd-source", "bsd-binary")),
    ("GPL-3.0-or-later", True, ("gpl-grant", "gpl-hope", "gpl-see")),
    ("GPL-2.0-or-later", True, ("gpl2-grant", "gpl-hope", "gpl-see")),
    ("BSD-1-Clause", False, ("bsd-grant", "bsd-source")),
    ("GPL-2.0-only", True, ("gpl2-only-grant", "gpl-hope", "gpl-see")),
    ("GPL-3.0-only", True, ("gpl3-only-grant", "gpl-hope", "gpl-see")),
    ("LGPL-3.0-or-later", True, ("lgpl3-grant", "lgpl-hope", "lgpl-see")),
    ("LGPL-3.0-or-later", True, ("lgpl3-grant", "gpl-hope", "lgpl-see")),
    ("LGPL-2.1-or-later", True, ("lgpl21-grant", "lgpl-hope", "lgpl-see")),
    ("AGPL-3.0-or-later", True, ("agpl3-grant", "gpl-hope", "agpl-see")),
    ("GPL-3.0-or-later", True, ("gpl-grant",)),
    ("GPL-2.0-or-later", True, ("gpl2-grant",)),
    ("GPL-2.0-only", True, ("gpl2-only-grant",)),
    ("GPL-3.0-only", True, ("gpl3-only-grant",)),
    ("LGPL-3.0-or-later", True, ("lgpl3-grant",)),
    ("LGPL-2.1-or-later", True, ("lgpl21-grant",)),
    ("AGPL-3.0-or-later", True, ("agpl3-grant",)),
    ("MPL-2.0", True, ("mpl2-grant", "mpl2-copy")),
    ("MPL-2.0", True, ("mpl2-grant",)),
    ("EPL-2.0", True, ("epl2-grant",)),
    ("EPL-1.0", True, ("epl1-grant",)),
    ("ISC", False, ("isc-grant", "isc-warranty")),
    ("ISC", False, ("isc-grant",)),
    ("0BSD", False, ("0bsd-grant", "isc-warranty")),
    ("0BSD", False, ("0bsd-grant",)),
    ("Unlicense", False, ("unlicense-free", "unlicense-anyone")),
    ("Unlicense", False, ("unlicense-free",)),
    ("Zlib", False, ("zlib-asis", "zlib-damages", "zlib-grant")),
    ("BSL-1.0", False, ("bsl1-grant",)),
    ("BSL-1.0", False, ("bsl1-line",)),
    ("WTFPL", False, ("wtfpl-do",)),
    ("CC-BY-4.0", False, ("ccby4-work",)),
    ("CC-BY-SA-4.0", True, ("ccbysa4-work",)),
    ("CC-BY-NC-4.0", True, ("ccbync4-work",)),
    ("CC-BY-NC-SA-4.0", True, ("ccbyncsa4-work",)),
    ("CC-BY-ND-4.0", True, ("ccbynd4-work",)),
    ("CC-BY-NC-ND-4.0", True, ("ccbyncnd4-work",)),
    ("GPL-3.0-only", True, ("gpl3-line",)),
    ("Apache-2.0", False, ("apache2-line",)),
    ("Apache-2.0", False, ("apache2-grant",)),
    ("MIT", False, ("mit-line",)),
    ("MIT", False, ("mit-grant",)),
    ("MIT", False, ("mit-title",)),
    ("CC-BY-NC-4.0", True, ("ccbync4-line",)),
    ("CC-BY-SA-4.0", True, ("ccbysa4-line",)),
    ("CC-BY-4.0", False, ("ccby4-line",)),
    ("CC0-1.0", False, ("cc0-line",)),
    ("All-Rights-Reserved", True, ("all-rights",)),
]

# Public licence identifiers, whether they restrict use for training, and their names.
NAMES: list[tuple[str, bool, tuple[str, ...]]] = [
    ("0BSD", False, ("Zero-Clause BSD License", "BSD Zero Clause License")),
    ("AFL-3.0", False, ("Academic Free License 3.0",)),
    ("AGPL-3.0-only", True, ()),
    ("AGPL-3.0-or-later", True, ("GNU Affero General Public License v3.0", "AGPL-3.0", "AGPLv3")),
    ("Apache-1.1", False, ("Apache License 1.1",)),
    ("Apache-2.0", False, ("Apache License 2.0", "Apache License, Version 2.0", "Apache 2.0 License")),
    ("Artistic-2.0", False, ("Artistic License 2.0",)),
    ("BSD-2-Clause", False, ("BSD 2-Clause License", "Simplified BSD License", "2-clause BSD license")),
    ("BSD-3-Clause", False, ("BSD 3-Clause License", "New BSD License", "3-clause BSD license", "Modified BSD License")),
    ("BSD-4-Clause", False, ("BSD 4-Clause License", "Original BSD License")),
    ("BSL-1.0", False, ("Boost Software License 1.0", "Boost Software License - Version 1.0")),
    ("CC-BY-3.0", False, ("CC BY 3.0", "Creative Commons Attribution 3.0")),
    ("CC-BY-4.0", False, ("CC BY 4.0", "Creative Commons Attribution 4.0", "Creative Commons Attribution 4.0 International")),
    ("CC-BY-SA-3.0", True, ("CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 3.0")),
    ("CC-BY-SA-4.0", True, ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0")),
    ("CC-BY-NC-3.0", True, ("CC BY-NC 3.0",)),
    ("CC-BY-NC-4.0", True, ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0")),
    ("CC-BY-NC-SA-3.0", True, ("CC BY-NC-SA 3.0",)),
    ("CC-BY-NC-SA-4.0", True, ("CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0")),
    ("CC-BY-ND-4.0", True, ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0")),
    ("CC-BY-NC-ND-4.0", True, ("CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0")),
    ("CC0-1.0", False, ("CC0 1.0", "CC0 1.0 Universal")),
    ("CDDL-1.0", True, ("Common Development and Distribution License 1.0",)),
    ("CECILL-2.1", True, ("CeCILL Free Software License Agreement v2.1",)),
    ("ECL-2.0", False, ("Educational Community License v2.0",)),
    ("EPL-1.0", True, ("Eclipse Public License 1.0", "Eclipse Public License - v 1.0")),
    ("EPL-2.0", True, ("Eclipse Public License 2.0", "Eclipse Public License - v 2.0")),
    ("EUPL-1.2", True, ("European Union Public License 1.2", "European Union Public Licence v. 1.2")),
    ("GFDL-1.3-or-later", True, ("GNU Free Documentation License",)),
    ("GPL-2.0-only", True, ("GNU General Public License, version 2", "GNU General Public License v2.0", "GPL-2.0", "GPLv2")),
    ("GPL-2.0-or-later", True, ("GPL-2.0+",)),
    ("GPL-3.0-only", True, ("GNU General Public License, version 3", "GNU General Public License v3.0", "GPL-3.0", "GPLv3")),
    ("GPL-3.0-or-later", True, ("GPL-3.0+",)),
    ("ISC", False, ("ISC License",)),
    ("LGPL-2.1-only", True, ("GNU Lesser General Public License v2.1", "LGPL-2.1", "LGPLv2.1")),
    ("LGPL-2.1-or-later", True, ("LGPL-2.1+",)),
    ("LGPL-3.0-only", True, ("GNU Lesser General Public License v3.0", "LGPL-3.0", "LGPLv3")),
    ("LGPL-3.0-or-later", True, ("LGPL-3.0+",)),
    ("LPPL-1.3c", False, ("LaTeX Project Public License v1.3c",)),
    ("MIT", False, ("MIT License", "The MIT License", "The MIT License (MIT)")),
    ("MIT-0", False, ("MIT No Attribution",)),
    ("MPL-1.1", True, ("Mozilla Public License 1.1", "Mozilla Public License Version 1.1")),
    ("MPL-2.0", True, ("Mozilla Public License 2.0", "Mozilla Public License Version 2.0", "Mozilla Public License, v. 2.0")),
    ("MS-PL", False, ("Microsoft Public License",)),
    ("NCSA", False, ("University of Illinois/NCSA Open Source License",)),
    ("OFL-1.1", False, ("SIL Open Font License 1.1", "SIL Open Font License, Version 1.1")),
    ("OSL-3.0", True, ("Open Software License 3.0",)),
    ("PostgreSQL", False, ("PostgreSQL License",)),
    ("PSF-2.0", False, ("Python Software Foundation License Version 2",)),
    ("Unlicense", False, ("The Unlicense", "Unlicense")),
    ("UPL-1.0", False, ("Universal Permissive License v1.0", "Universal Permissive License, Version 1.0")),
    ("WTFPL", False, ("Do What The F*ck You Want To Public License",)),
    ("Zlib", False, ("zlib License",)),
]
#: How a licence is named in one line: its name alone is a title, the rest are notices.
LINES = ("{}", "Licensed under {}.", "Licensed under the {}.", "Released under {}.", "Released under the {}.", "This project is licensed under the {}.", "This work is licensed under the {}.", "This software is licensed under the {}.", "Distributed under the {}.", "{} licensed.")


def named_lines() -> tuple[list[tuple[str, str]], list[tuple[str, bool, tuple[str, ...]]]]:
    """Sentences and rules of one line for each of NAMES: its SPDX line, its title and its notices."""
    sentences, rules, taken = [], [], {normalise(s) for _, s in SENTENCES}
    for licence, restricts, names in NAMES:
        lines = [f"SPDX-License-Identifier: {licence}"] + [line.format(name) for name in names for line in LINES]
        lines += [f"SPDX-License-Identifier: {name}" for name in names if " " not in name]
        for line in lines:
            if (plain := normalise(line)) not in taken:
                taken.add(plain)
                sentences.append((f"line:{licence}", line))
        rules.append((licence, restricts, (f"line:{licence}",)))
    return sentences, rules


_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?;:)"]] = True
_NUMBER = re.compile(rb"[^0-9A-Za-z]*(?:[0-9]{1,3}|[A-Za-z])[.)]\s*")


def normalise(sentence: str) -> str:
    """The sentence's lower-case runs of ASCII letters and digits, joined by spaces; a plus after a digit (``GPL-2.0+``) stays."""
    return " ".join(re.findall(r"[a-z0-9]+(?:\.[0-9]+)*(?:(?<=[0-9])\+)?", re.sub("[A-Z]", lambda m: m[0].lower(), sentence)))


#: An open place in a sentence: from one to OPEN_WORDS words of any kind stand there (a holder's name).
OPEN, OPEN_WORDS = "<...>", 12


class Known(dict):
    """Normal forms of known sentences and their identifiers; those with open places are found by what stands around them."""

    def __init__(self, sentences: list[tuple[str, str]]):
        super().__init__((normalise(s), name) for name, s in sentences if OPEN not in s)
        self.patterns = [([normalise(x).split() for x in s.split(OPEN)], name) for name, s in sentences if OPEN in s]
        self.most = max([len(x.split()) for x in self] + [sum(map(len, parts)) + OPEN_WORDS * (len(parts) - 1) for parts, _ in self.patterns], default=0)

    def __missing__(self, said: str) -> str | None:
        words = said.split()
        return next((name for parts, name in self.patterns if fits(words, parts)), None)

    def __contains__(self, said: object) -> bool:
        return self[said] is not None


def fits(words: list[str], parts: list[list[str]]) -> bool:
    """Whether the words are the parts in their order, with 1 to OPEN_WORDS others between two of them."""
    if words[: len(parts[0])] != parts[0]:
        return False
    if len(parts) == 1:
        return len(words) == len(parts[0])
    rest = words[len(parts[0]) :]
    return any(fits(rest[k:], parts[1:]) for k in range(1, min(OPEN_WORDS, len(rest)) + 1))


_sentences, _rules = named_lines()
SENTENCES += _sentences
RULES += _rules


def split_sentences(text: str, known: Container[str] | None = None) -> list[str]:
    """The text's known sentences (those of ``SENTENCES`` by default), and the pieces between them."""
    known = Known(SENTENCES) if known is None else known
    pieces, out, k = re.split(r"(?<=[.!?;:)])(?=[\x20\x09\x0B-\x0D])|(?<=\n)", text), [], 0
    most = known.most if isinstance(known, Known) else max((len(s.split()) for s in known), default=0)
    while k < len(pieces):
        end, _ = longest_known(k, len(pieces), lambda j: normalise(pieces[j]), lambda j: not j or pieces[j - 1].endswith("\n"), known, most)
        out.append("".join(pieces[k:end]))
        k = end
    return out


def longest_known(k: int, stop: int, words: Callable[[int], str], opens_line: Callable[[int], bool], known: Container[str], most: int) -> tuple[int, str]:
    """End and normal form of the longest known sentence of whole pieces from k, of at most ``most`` words; (k + 1, "") if there is none."""
    end, name, run = k + 1, "", []
    for j in range(k, stop):
        more = words(j).split()
        if not more and (j == k or opens_line(j)):
            break
        run += more
        if len(run) > most:
            break
        if more and (joined := " ".join(run)) in known:
            end, name = j + 1, joined
    return end, name


def sentence_places(raw: bytes, start: np.ndarray, end: np.ndarray, first: int, spans: list[tuple[int, int]]) -> list[int]:
    """Sentence numbers of known sentences at the given runs of pieces, in a text whose pieces begin at ``first``."""
    out, number, at, within = [], 0, first, False
    for a, z in spans:
        for k in range(at, a):
            piece = raw[start[k] : end[k]]
            if not re.search(rb"[0-9A-Za-z]", piece):
                ends = within and (k == first or raw[start[k] - 1] == 10)
            elif _NUMBER.fullmatch(piece):
                continue
            else:
                within, ends = True, piece.rstrip()[-1] in b".!?;:"
            if ends:
                number, within = number + 1, False
        number, within, at = number + within, False, z
        out.append(number)
        number += 1
    return out


def match_rules(ids: list[str], places: list[int], rules: list[tuple[str, bool, tuple[str, ...]]], gap: int) -> list[tuple[str, bool, int, int]]:
    """(licence, restricts, first and last place) for identifiers at ascending sentence numbers;
    within a rule at most ``gap`` unknown sentences may stand between two of its own."""
    out, at = [], 0
    while at < len(ids):
        for licence, restricts, need in rules:
            to = at + len(need)
            if tuple(ids[at:to]) == need and all(b - a <= gap + 1 for a, b in zip(places[at:to], places[at + 1 : to], strict=False)):
                out.append((licence, restricts, places[at], places[to - 1]))
                at = to
                break
        else:
            at += 1
    return out


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gap: int = 1, sentences: list[tuple[str, str]] | None = None, rules: list[tuple[str, bool, tuple[str, ...]]] | None = None) -> DataFrame:
    """Returns ``id_col, n_known_sentences, sentence_ids, licenses, restricted, matches`` for each row.

    licenses: the distinct licences in order of their first match; matches: (licence, first and last
    sentence number).  restricted: some match restricts use.

    Whole texts are scanned: a fingerprint of the first two words from every piece on is
    looked up first, and what fits is normalised and compared in full.

    Cases: null and empty texts, and texts without known sentences, have empty lists and
    false.  A very long text is scanned whole.  Repeated rows and null ids have results like any other row.  An empty table gives an
    empty result.  Other columns are ignored.
    """
    table = Known(SENTENCES if sentences is None else sentences)
    ordered, most = RULES if rules is None else rules, table.most
    begin = [*table, *(" ".join(parts[0]) for parts, _ in table.patterns)]  # an open place comes after two words or more
    openings = {n: np.unique(_openings([s for s in begin if min(2, len(s.split())) == n], n)) for n in (1, 2)}
    kinds = "id long, n_known_sentences long, sentence_ids array<string>, licenses array<string>, restricted boolean, matches array<struct<license: string, first: long, last: long>>"
    match_type = pa.list_(pa.struct([("license", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.slices(batches):
            buf, offs = tb.text_buffer(batch.column("text"))
            n = batch.num_rows
            ids, lic, bad, hits = [[] for _ in range(n)], [[] for _ in range(n)], [False] * n, [[] for _ in range(n)]
            start, end, first = sentence_spans(buf, offs)
            text_end = np.repeat(offs[1:], np.diff(first))
            likely = np.zeros(len(start), bool)
            for n_words, hashes in openings.items():
                if len(hashes):
                    likely |= np.isin(_opening_hash(buf, start, text_end, n_words), hashes)
            raw = buf.tobytes()
            owner = np.searchsorted(first, np.flatnonzero(likely), "right") - 1
            found: dict[int, list[tuple[str, int, int]]] = {}
            words, opens_line = lambda j: normalise(raw[start[j] : end[j]].decode(errors="replace")), lambda j: raw[start[j] - 1] == 10
            taken = 0
            for k, row in zip(np.flatnonzero(likely).tolist(), owner.tolist(), strict=True):
                if k < taken:
                    continue
                z, known = longest_known(k, int(first[row + 1]), words, opens_line, table, most)
                if known:
                    found.setdefault(row, []).append((table[known], k, z))
                    taken = z
            for row, known in found.items():
                ids[row] = [x[0] for x in known]
                places = sentence_places(raw, start, end, int(first[row]), [x[1:] for x in known])
                for licence, restricts, a, z in match_rules(ids[row], places, ordered, gap):
                    hits[row].append({"license": licence, "first": a, "last": z})
                    bad[row] |= restricts
                lic[row] = list(dict.fromkeys(h["license"] for h in hits[row]))
            texts = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, texts), pa.array(lic, texts), pa.array(bad), pa.array(hits, match_type)],
                names=["id", "n_known_sentences", "sentence_ids", "licenses", "restricted", "matches"],
            )

    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(run, kinds).withColumnRenamed("id", id_col)


def sentence_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every piece, as ``split_sentences`` cuts, and each text's first."""
    n = len(buf)
    head = np.zeros(n + 1, bool)
    if n:
        head[1:n] = (_STOP[buf[:-1]] & tb.WHITE[buf[1:]] & (buf[1:] != 10)) | (buf[:-1] == 10)
    head[offs[:-1][np.diff(offs) > 0]] = True
    start = np.flatnonzero(head[:n])
    return start, np.append(start[1:], n) if len(start) else start, np.searchsorted(start, offs)


def _opening_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray, n_words: int) -> np.ndarray:
    """A fingerprint of the first one or two runs of letters and digits from each start to its end."""
    if not len(start):
        return np.zeros(0, np.uint64)
    solid = _ALNUM[buf]
    edge = np.zeros(len(buf), bool)
    edge[1:] = solid[1:] != solid[:-1]
    edge[start] = True
    run_start = np.flatnonzero(edge & solid)
    last = np.zeros(len(buf), bool)
    last[:-1] = solid[:-1] & (~solid[1:] | edge[1:])
    last[-1] = solid[-1]
    run_end = np.flatnonzero(last) + 1
    hashes = np.append(tb.span_hash(buf, run_start, run_end, lower=True), np.zeros(2, np.uint64))
    a = np.searchsorted(run_start, start)
    here = np.append(run_start, [len(buf) + 1] * 2)
    one = np.where(here[a] < end, hashes[a], np.uint64(0))
    if n_words == 1:
        return tb.mix(one)
    two = np.where(here[np.minimum(a + 1, len(here) - 1)] < end, hashes[np.minimum(a + 1, len(hashes) - 1)], np.uint64(0))
    return tb.mix(one * np.uint64(31) + two)


def _openings(sentences: list[str], n_words: int) -> np.ndarray:
    buf, offs = tb.text_buffer(pa.array(sentences, pa.string()))
    return _opening_hash(buf, offs[:-1], offs[1:], n_words)
