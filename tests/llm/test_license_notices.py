"""Notices of a few words, which hold little of any template."""

import pyarrow as pa

from mergeloom.llm import licenses


def test_short_license_notices(docs):
    model = licenses.fit([r.text for r in docs.limit(100).collect()])
    texts = {
        "x y\nAll rights reserved.\nmore": "proprietary", "ALL RIGHTS RESERVED": "proprietary", "Copyright 2020 Example Ltd. All rights reserved.": "proprietary", "MIT License": "mit", "Apache License": "apache", "GNU General Public License": "gpl",
        "All the rights of the guests were reserved for the evening.": None, "All seats are reserved.": None, "Students of MIT need a license.": None,
    }
    got = {r[0]: r for r in licenses.scan_texts(pa.array(list(texts)), model)}
    assert [got[i][1] if i in got else None for i in range(len(texts))] == list(texts.values())
    assert list(texts)[0][got[0][2] : got[0][3]] == "All rights reserved"
