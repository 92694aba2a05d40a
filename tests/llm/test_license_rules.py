"""Every licence rule is met by its verbatim text, plain and commented."""

import pytest

from lexweave.llm import licenses

MIT = """Copyright (c) 2020 X

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
APACHE = """Copyright 2020 X

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
BSD3 = BSD2 + """

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
APACHE_HEAD = """                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION

   1. Definitions."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
VERBATIM = {("apache-2-head", "apache-2-terms"): APACHE_HEAD, ("mpl-2-form", "mpl-2-copy-2"): MPL, ("mit-grant", "mit-condition"): MIT, ("apache-2-grant", "apache-2-use", "apache-2-copy"): APACHE, ("gpl-free", "gpl-hope", "gpl-see"): GPL, ("bsd-use", "bsd-source", "bsd-binary"): BSD2, ("bsd-use", "bsd-source", "bsd-binary", "bsd-endorse"): BSD3}


def commented(text, sign):
    if sign == "/*":
        return "/*\n" + "\n".join(f" * {x}".rstrip() for x in text.split("\n")) + "\n */\nint main;"
    if sign == "box":
        return "/" + "*" * 90 + "\n" + "\n".join(f"* {x:84} *" for x in text.split("\n")) + "\n" + "*" * 90 + "/\nint main;"
    return "\n".join(f"{sign} {x}".rstrip() for x in text.split("\n")) + "\ncode = 1" if sign else text


@pytest.mark.parametrize("sign", ["", "#", "//", "--", ";;", "%", "/*", "box"])
def test_every_rule(spark, sign):
    texts = [commented(VERBATIM.get(ids) or "\n".join(licenses.SENTENCES[k] for k in ids), sign) for _, ids in licenses.RULES]
    found = licenses.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).orderBy("id").collect()
    assert [r.licences for r in found] == [[name] for name, _ in licenses.RULES]


def test_both_bsd_licences_in_one_text(spark):
    one = licenses.scanned(spark.createDataFrame([(1, BSD2 + "\n\nOther words.\n\n" * 5 + BSD3), (2, GPL.replace("WARRANTY;", "WARRANTY; some words.")), (3, None)], "doc_id bigint, text string")).orderBy("id").collect()
    assert [r.licences for r in one] == [["BSD-2-Clause", "BSD-3-Clause"], [], []]
