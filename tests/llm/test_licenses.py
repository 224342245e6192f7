from pathlib import Path

import pytest

from tidemark.llm import licenses

BODY = licenses.LICENSES["MIT"].split("\n\n", 1)[1]
BSD = licenses.MORE["BSD-3-Clause"]


def named(spark, texts):
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [r["license_id"] for r in sorted(rows, key=lambda r: r["doc_id"])]


def test_copyright_lines_of_any_form_and_titles_do_not_matter(spark):
    forms = ["(c) 2020 X", "© 2020 X", "Copyright X Inc., 2020", "Copyright © X", "Copyright (c) 2020 X\nAll rights reserved.", ""]
    assert named(spark, [f"{t}\n\n{f}\n\n{BODY}" for f in forms for t in ("", "The MIT License (MIT)")]) == ["MIT"] * 12


def test_more_licences_and_prose(spark):
    texts = [BSD, "BSD 3-Clause License\n\nCopyright (c) 2020, X\n\n" + BSD.replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* "), licenses.MORE["Unlicense"].replace("http:", "https:")]
    assert named(spark, [*texts, "Copyright law is old.\n" + BODY, "copyright 2020 x", None]) == ["BSD-3-Clause", "BSD-3-Clause", "Unlicense", None, None, None]


def test_long_texts(spark):
    folder = Path("/usr/share/common-licenses")
    if not folder.is_dir():
        pytest.skip("no licence texts on this machine")
    want = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}
    assert named(spark, [(folder / f).read_text() for f in want]) == list(want.values())
