"""The model queries take every sample of the table."""

import numpy as np
import pyarrow.parquet as pq

from locusframe.operators import genotype, kinship
from locusframe.plans import queries
from locusframe.plans import views as v


def test_models_take_all_samples(spark, sf_dir):
    n = pq.ParquetFile(f"{sf_dir}/embeddings.parquet").metadata.num_rows
    panel, y = queries._panel(spark, sf_dir)
    assert n > 100 and len(y) == n
    assert {len(r["dosages"]) for r in panel.select("dosages").collect()} == {n}
    got = kinship.gathered(queries.m3_kinship(spark, sf_dir))
    x = genotype.dosage_matrix(v.genotypes(spark, sf_dir).select("dosages").toArrow().column("dosages").combine_chunks())
    x = x[x.var(axis=1) > 1e-12]
    z = genotype.standardized(x, x.mean(axis=1))
    k = z.T @ z
    assert np.allclose(got, k / np.mean(np.diag(k)))
    assert queries.m6_ols_scan(spark, sf_dir).count() == 2 * 3 * panel.count()
    assert queries.m4_mixed_scan_loco(spark, sf_dir).count() == panel.count()
