import time

import pytest

from feedspan.llm import license_scan as module
from feedspan.llm.license_scan import license_scan, scan_text, sentences

from helpers import awkward, documents

MIT = (
    "MIT License\n\nCopyright (c) 2020 Someone\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\n"
    "of this software and associated documentation files.\n\nThe above copyright notice and this permission notice shall be "
    "included in all\ncopies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND. IN NO EVENT SHALL THE\n"
    "AUTHORS BE LIABLE FOR ANY CLAIM."
)
BSD = (
    "# Redistribution and use in source and binary forms, with or without modification, are permitted.\n"
    "# Redistributions of source code must retain the above copyright notice.\n"
    "# Redistributions in binary form must reproduce the above copyright notice.\n"
)


@pytest.mark.parametrize("text, want", [
    ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]),
    ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0-only"]),
    ("Licensed under the Apache License, Version 2.0.", ["Apache-2.0"]),
    ("Released under the MIT License.", ["MIT"]),
    ("some prose before. released under the mit licence. more prose", ["MIT"]),
    (MIT, ["MIT"]),
    (BSD, ["BSD-2-Clause"]),
    (BSD + "# Neither the name of X nor its contributors may be used to endorse products.\n", ["BSD-3-Clause"]),
    ("// SPDX-License-Identifier: Apache-2.0", ["Apache-2.0"]),
    ("This program is free software; you can redistribute it under the terms of the GNU Lesser General Public License; "
     "either version 2.1 of the License, or (at your option) any later version.", ["LGPL-2.1-or-later"]),
    ("This is not licensed under the MIT License.", []),
    ("I have a driving license and a permission.", []),
    ("All rights reserved. Copyright 2020.", []),
    ("Licensed under the Apache License, Version 2.0. Released under the MIT License.", ["Apache-2.0", "MIT"]),
])
def test_rules(text, want):
    assert sorted({name for name, *_ in scan_text(text)[0]}) == want


def test_order_of_sentences_matters():
    """Parts of a licence in the wrong order are known sentences, not a licence."""
    hits, unmatched = scan_text("Redistributions in binary form must reproduce the notice. Redistributions of source code must retain the notice.")
    assert hits == [] and unmatched == 2


def test_sentences_keep_versions_and_wrapped_lines():
    assert sentences("Version 2.0 of\nthis. Next\n\nblock") == ["version 2.0 of this", "next", "block"]


def test_every_planted_line_is_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lines = {
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Released under the MIT License.": "MIT",
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only",
    }
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.licenses for r in license_scan(docs).collect()}
    assert got == {i: sorted({n for line, n in lines.items() if line in t}) for i, t in texts.items()}


def test_awkward_rows(spark):
    got = license_scan(awkward(spark)).collect()
    assert len(got) == 12 and all(r.licenses == [] and r.spans == [] and r.n_unmatched == 0 for r in got)
    assert license_scan(documents(spark, [])).count() == 0
    long = documents(spark, [(1, "word " * 300_000 + ". Released under the MIT License.")])
    assert license_scan(long).first().licenses == ["MIT"]


#: One or more sentences for each pattern.
EXAMPLES = {
    "Negated": ["not available under"],
    "Spdx": ["SPDX-License-Identifier: MIT"],
    "MitGrant": ["Permission is hereby granted, free of charge, to any person obtaining a copy"],
    "MitNotice": ["The above copyright notice and this permission notice shall be included"],
    "IscGrant": ["Permission to use, copy, modify, and/or distribute this software for any purpose"],
    "AsIs": ["software is provided as is"],
    "NoLiability": ["In no event shall they be liable"],
    "BsdGrant": ["Redistribution and use in source and binary forms, with or without modification, are permitted"],
    "BsdSource": ["Redistributions of source code must retain"],
    "BsdBinary": ["Redistributions in binary form must reproduce"],
    "BsdEndorse": ["Neither the name of X may be used to endorse"],
    "BsdAdvert": ["All advertising materials mentioning features"],
    "GplFree": ["This library is free software, general public license", "This file is free software, lesser general public licence"],
    "GplNoWarranty": ["Distributed in the hope that it will be useful"],
    "GplCopy": ["You should have received a copy of the GNU"],
    "Apache": ["released under Apache 2.0", "covered by the apache"],
    "ApacheLimits": ["Unless required by applicable law or agreed to in writing, software distributed under the licence"],
    "ApacheCopy": ["You may obtain a copy of the licence at"],
    "Mit": ["covered by the expat licence", "MIT license"],
    "Bsd": ["released under the new BSD", "provided under a 3-clause BSD"],
    "Gnu": ["distributed under the GPL v3", "available under AGPL", "published under lgpl-3.0", "provided by gfdl",
            "covered by the free documentation licence", "covered by the general public licence"],
    "Mpl": ["Mozilla Public Licence 2.0"],
    "CreativeCommons": ["shared under CC BY-SA 4.0", "available under Creative Commons Attribution 4.0"],
    "PublicDomain": ["placed into the public domain", "This work is in the public domain"],
    "AllRights": ["All rights reserved"],
    "Copyright": ["Portions copyright me", "(c) 1999"],
}


def test_a_text_is_skipped_only_if_no_pattern_matches(monkeypatch):
    texts = [t for group in EXAMPLES.values() for t in group]
    assert EXAMPLES.keys() == {name for name, *_ in module.KNOWN}
    for name, group in EXAMPLES.items():
        pattern = next(k[-1] for k in module.KNOWN if k[0] == name)
        assert all(pattern.search(sentences(t)[0]) for t in group)
    got = [scan_text(t) for t in texts]
    assert all(hits or unmatched for hits, unmatched in got)
    monkeypatch.setattr(module, "KNOWN", [(name, ("",), pattern) for name, _, pattern in module.KNOWN])
    assert [scan_text(t) for t in texts] == got


@pytest.mark.parametrize("text, want", [
    ("It is released under Apache 2.0.", "Apache-2.0"), ("Distributed under the GPL v3.", "GPL-3.0-only"),
    ("Shared under CC BY-SA 4.0.", "CC-BY-SA-4.0"), ("Available under Creative Commons Attribution 4.0.", "CC-BY-4.0"),
])
def test_sentences_without_the_word_licence(text, want):
    assert [name for name, *_ in scan_text(text)[0]] == [want]


GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, subject to the\n"
    "following conditions:\nThe above copyright notice and this permission notice shall be included in all copies."
)


@pytest.mark.parametrize("text, want", [
    ("Licensed under the MIT license or the Apache License, Version 2.0", ["MIT", "Apache-2.0"]),
    ("Licensed under either the Apache License, Version 2.0 or the MIT license, at your option.", ["Apache-2.0", "MIT"]),
    ("Dual licensed under the MIT and GPL v3 or later licenses.", ["MIT", "GPL-3.0-or-later"]),
    ("Released under the MIT License, the Mozilla Public License 2.0 and the GNU GPL v2.", ["MIT", "MPL-2.0", "GPL-2.0-only"]),
    ("Licensed under MIT/Apache-2.0.", ["MIT", "Apache-2.0"]),
    ("Code is licensed under the MIT license, text is licensed under CC BY-SA 4.0.", ["MIT", "CC-BY-SA-4.0"]),
    ("This is not licensed under the MIT License but released under the Apache License 2.0.", ["Apache-2.0"]),
    ("This program is free software under the GNU General Public License version 2 and licensed under the Apache License, version 1.1",
     ["GPL-2.0-only", "Apache-1.1"]),
    ("SPDX-License-Identifier: MIT OR Apache-2.0", ["MIT", "Apache-2.0"]),
    ("/* SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) OR MIT */", ["GPL-2.0-only WITH linux-syscall-note", "MIT"]),
    ("# SPDX-License-Identifier: MIT\n# SPDX-License-Identifier: BSD-3-Clause\nand more", ["MIT", "BSD-3-Clause"]),
    ("SPDX-License-Identifier: MIT and nothing else", ["MIT"]),
    ("Copyright (c) 2020 Foo\n" + GRANT, ["MIT"]),
    ("Foo 1.0, Copyright (c) 2020 Foo\n" + GRANT, ["MIT"]),
    ("Copyright (c) 2020 Foo, licensed under the\nApache License, Version 2.0", ["Apache-2.0"]),
    ("MIT License\nCopyright (c) 2020 Foo\nand others", ["MIT"]),
    ("Released under the MIT license and other things, or nothing.", ["MIT"]),
    ("Licensed by MIT and Stanford.", []), ("Licensed under the BSD license, MIT Press.", ["BSD"]),
    ("Not licensed under the Mozilla Public License 2.0 or the GPL v2.", []),
    ("Licensed under Creative Commons Attribution ShareAlike 4.0.", ["CC-BY-SA-4.0"]),
    ("Licensed under the Creative Commons Attribution-NonCommercial-NoDerivs 3.0 Unported License.", ["CC-BY-NC-ND-3.0"]),
])
def test_all_licences_of_a_sentence(text, want):
    assert [name for name, *_ in scan_text(text)[0]] == want


@pytest.mark.parametrize("unit", [
    "this program is free software ", "this program is free software under the general public license ", "in no event shall ",
    "neither the name of ", "the software is provided by the ", "licensed under the general public license ",
    "licensed under the gpl version 3 ", "released under mit (", "spdx-license-identifier: mit or ", "copyright (c) 2020\n",
    "Released under the MIT License. ", "\n \n", "// ", "All rights reserved. ",
])
def test_repeated_beginnings_take_linear_time(unit):
    def spent(n):
        start = time.perf_counter()
        scan_text(unit * (n // len(unit)))
        return time.perf_counter() - start

    once = min(spent(150_000) for _ in range(2))
    assert min(spent(300_000) for _ in range(2)) < max(2.6 * once, 0.5)


@pytest.mark.parametrize("text, want", [
    ("this program is free software and " * 3 + "comes under the GNU General Public License version 2 or any later version",
     ["GPL-2.0-or-later"]),
    ("This library is free software under the GNU Lesser General Public License, and see the MIT licence, version 3.", ["LGPL"]),
    ("Licensed under the GPL v2 or later.", ["GPL-2.0-or-later"]),
    ("Licensed under the GPL-3.0+.", ["GPL-3.0-or-later"]),
    ("Licensed under the GPL v2, parts under the Apache License 2.0 or later.", ["Apache-2.0", "GPL-2.0-only"]),
])
def test_what_follows_at_a_distance(text, want):
    found = {name for name, *_ in scan_text(text)[0]}
    assert set(want) - {"Apache-2.0"} <= found and not found & {"GPL-3.0-only", "LGPL-3.0-only", "GPL-2.0"}


def test_unmatched_sentences_are_those_outside_every_run():
    hits, unmatched = scan_text("Redistributions in binary form must reproduce it. " * 2 + "Released under the MIT License. All rights reserved.")
    assert [h[0] for h in hits] == ["MIT"] and unmatched == 3
