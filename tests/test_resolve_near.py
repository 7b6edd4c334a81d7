"""Imports of one file from many folders are one search, with the targets of a search for each."""

from helpers import files_df, rows
from linkloom.functions import paths
from linkloom.functions.languages import ScanOptions
from linkloom.operators import resolve as R


def test_js_targets_are_searched_once(spark, monkeypatch):
    tree = {f"p{k}/{k}/a.js": f"const x = require(\"../../lib/util\")\nimport {{b}} from '../../lib/side/'; import 'react'\nrequire('./gone-{k % 2}')\nx = \"import 'q\"" for k in range(40)}
    tree |= {"lib/util.ts": "import '../p1/1/a'", "lib/side/index.jsx": "import * as y from \"..\"\nrequire( './' )", "top.js": "require('./lib/util.ts')"}
    tree |= {f"r{k}/{k}.rb": "require_relative '../lib/u'\nrequire_relative 'v'" for k in range(20)} | {"lib/u.rb": ""}
    sizes = {}
    written = R.write_table

    def counted(df, label):
        out, n = written(df, label)
        sizes[label] = n
        return out
    monkeypatch.setattr(R, "materialize", counted)
    monkeypatch.setattr(R, "BROADCAST_ROWS", 0)
    edges, _ = R.file_graph(files_df(spark, tree), ScanOptions(languages=("js", "ruby"), hide_external=True))
    want = [(f"p{k}/{k}/a.js", t) for k in range(40) for t in ("lib/util.ts", "lib/side/index.jsx", f"p{k}/{k}/gone-{k % 2}")]
    want += [("lib/util.ts", "p1/1/a.js"), ("top.js", "lib/util.ts"), ("lib/side/index.jsx", "lib"), ("lib/side/index.jsx", "lib/side/index.jsx")]
    want += [(f"r{k}/{k}.rb", t) for k in range(20) for t in ("lib/u.rb", f"r{k}/v.rb")]
    assert rows(edges, "source", "target") == sorted(want)
    assert sizes["hits"] <= 5  # one for each target found; one for each importing folder before


def test_normal_paths(spark):
    cases = {"": ".", ".": ".", "a/..": ".", "a/../..": "..", "/..": "/", "a//b/./c/../d": "a/b/d", "../a": "../a", "a/b": "a/b", "\n": "\n", "./\n": "\n"}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r.p: r.n for r in df.select("p", paths.normalize("p").alias("n")).collect()} == cases
