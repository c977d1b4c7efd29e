"""Print the scale-relevant facts of the main search plans (partition
pruning, pushed filters, join strategies, partial top-k, exchanges).
usage: python tests/show_plans.py [sf_dir]"""
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from docsift.operators import hybrid as H  # noqa: E402
from docsift.operators import lexical as L  # noqa: E402
from docsift.plans import corpus, registry  # noqa: E402
from docsift.session import get_session  # noqa: E402
from docsift.sources.fixtures import table  # noqa: E402

MARKS = ["PartitionFilters: \\[[^\\]]+\\]", "PushedFilters: \\[[^\\]]*\\]", "ReadSchema: [^\\n]+",
         "BroadcastHashJoin", "SortMergeJoin", "BroadcastNestedLoopJoin", "CartesianProduct",
         "WindowGroupLimit", "Exchange hashpartitioning\\([^)]*\\)", "Exchange SinglePartition",
         "MapInPandas", "FlatMapCoGroupsInPandas", "HashAggregate\\(keys=\\[[^\\]]*\\]"]


def facts(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    out = []
    for m in MARKS:
        found = sorted(set(re.findall(m, plan)))
        out += [f"  {x[:160]}" for x in found]
    return "\n".join(out)


sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
spark = get_session(8)
docs = table(spark, sf, "documents")
idx = H.SearchIndex.build(corpus.chunk_table(docs), corpus.document_sources(docs))
q = registry.bench_queries(spark, sf)
hits = H.bm25_hits(q, idx)
for name, df in [("bm25 ranking (F4-F6)", hits),
                 ("semantic ranking (G2/G8)", H.semantic_hits(q, idx)),
                 ("hit text lookup (B2/H1)", H._attach(hits, idx)),
                 ("chunk table build (C7-C13)", corpus.chunk_table(docs, materialize=lambda d: d)),
                 ("bm25 postings (F1)", L.bm25_postings(L.passages(idx.chunks)))]:
    print(f"== {name}\n{facts(df)}\n", flush=True)
