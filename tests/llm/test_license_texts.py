from hybridkb.llm.licenses import _BSD_BINARY, _BSD_END, _BSD_HEAD, _BSD_NAMES, _BSD_SOURCE, _ISC, _MIT, scan_licenses


def test_whole_files_and_their_paragraphs(spark):
    mit = "MIT License\n\nCopyright (c) 2024 Jane Doe\n\n" + "\n\n".join(x.replace(", ", ",\n") for x in _MIT) + "\n"
    isc = "ISC License\n\nCopyright 2024 Jane Doe\n\n" + "\n\n".join(_ISC) + "\n"
    bsd = "Copyright 2024 Jane Doe\n\n" + "\n\n".join([_BSD_HEAD, "1. " + _BSD_SOURCE, "2. " + _BSD_BINARY, "3. " + _BSD_NAMES, _BSD_END]) + "\n"
    other = " ".join(f"w{i}" for i in range(2000))
    docs = spark.createDataFrame([(1, mit), (2, isc), (3, bsd), (4, f"{other}\n\n{mit}\n{other}"), (5, other)], "doc_id long, text string")
    got = {r.doc_id: set(r.licenses) for r in scan_licenses(docs).collect()}
    assert {"MIT-text", "MIT-permission", "MIT-condition", "MIT-disclaimer"} <= got[1] and {"ISC-text", "ISC"} <= got[2]
    assert {"BSD-3-Clause-text", "BSD-3-Clause-names", "BSD-conditions"} <= got[3]
    assert {"MIT-permission", "MIT-disclaimer"} <= got[4] and got[5] == set()
