"""License notices that are wrapped, as the licenses' own texts are."""

from locusframe.llm import licenses

NOTICES = {
    "mit": "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated\ndocumentation files (the \"Software\"), to deal in it",
    "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:",
    "gpl": "# you can redistribute it and/or modify\n# it under the terms of the GNU General Public License\n# as published by the Free Software Foundation",
    "apache-2": "you may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0",
}


def test_wrapped_notices(spark, tmp_path):
    fill = [" ".join(f"word{i % 97}" for i in range(n)) for n in (0, 5, 36, 37, 50, 74, 300)]
    rows = [(label, f"{x}\n{notice}\n{x}\nend") for label, notice in NOTICES.items() for x in fill]
    # A notice's words far apart are no notice.
    rows += [("", ("\n" + fill[4] + "\n").join(notice.split("\n"))) for label, notice in NOTICES.items() if label != "apache-2"]
    spark.createDataFrame([(i, x) for i, (_, x) in enumerate(rows)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.op3_license_scan(spark, str(tmp_path)).collect()}
    assert {i: x[0] for i, x in got.items()} == {i: label for i, (label, _) in enumerate(rows)}
    assert all(got[i][1] >= licenses.CONTAINS for i, (label, _) in enumerate(rows) if label)
