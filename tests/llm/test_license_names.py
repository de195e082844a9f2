"""Name and version decide between licenses whose statements share most words."""

import pytest

from leadlens.llm import licenses
from tests.llm.conftest import prose

GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU %s as published by "
    "the Free Software Foundation, either version %s of the License, or (at your option) any later version."
)


def names(text):
    return [m[0] for m in licenses.scan_text(licenses.Index(), f"{prose(1, 30)} {text} {prose(2, 30)}")]


def test_the_best_template_is_reported_alone():
    for name, template in licenses.TEMPLATES.items():
        assert names(template) == [name]


@pytest.mark.parametrize("text, expected", [
    (GNU % ("Affero General Public License", "3"), ["agpl-3.0-notice"]),
    (GNU % ("General Public License", "2"), ["gpl-2.0-notice"]),
    (GNU % ("Lesser General Public License", "2.1"), ["lgpl-2.1-notice"]),
    (GNU % ("Lesser General Public License", "4"), []),
    (GNU % ("General Public License", "4"), []),
    ("This work is licensed under the GNU General Public License, version 2.", ["gpl-2.0-line"]),
    ("This work is licensed under the GNU General Public License, version 2. 3 files", ["gpl-2.0-line"]),
    ("Released under the ISC License.", ["isc-line"]),
    ("Released under the Foo License.", []),
    ("Licensed under CC BY-NC-SA 4.0.", ["cc-by-nc-sa-4.0-line"]),
    ("Licensed under CC BY-NC 2.0.", []),
    ("Released under the MIT License or licensed under the Apache License, Version 2.0.", ["mit-line", "apache-2.0-line"]),
    ("Released under the MIT License. Licensed under CC BY 4.0. Released under the MIT License.", ["mit-line", "cc-by-4.0-line", "mit-line"]),
])
def test_names_and_versions(text, expected):
    assert names(text) == expected
