"""Genotype-phenotype association over variation graphs, expressed as Spark jobs."""
