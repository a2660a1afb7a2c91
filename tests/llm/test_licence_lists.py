import pytest

from inkwell.llm import licenses


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("License: MIT\nLicense: Apache-2.0", ["MIT", "Apache-2.0"]),
        ("License: MIT\nsome words\n# License: ISC\n\t// License: Apache-2.0\nend", ["MIT", "ISC", "Apache-2.0"]),
        ("# SPDX-License-Identifier: Apache-2.0\n# " + licenses.SENTENCES["gpl2-grant"], ["Apache-2.0", "GPL-2.0"]),
        ("Licensed under the Apache License,\nVersion 2.0\nLicense: MIT\nRows end here.", ["Apache-2.0", "MIT"]),
        ("License: MIT\nReleased under the\nISC License.", ["MIT", "ISC"]),
    ],
)
def test_lists_of_notices_without_full_stops(text, expected):
    found = licenses.Scanner().scan(text)
    assert [m[0] for m in found] == expected
    ends = [(a, a + n) for _, _, a, n in found]
    assert all(b <= c for (_, b), (c, _) in zip(ends, ends[1:], strict=False)) and ends[-1][1] <= len(text)
