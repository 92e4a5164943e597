"""hyposcape: large-scale multiple hypothesis testing with spatial or graph structure on Spark.

Relations carry one row per hypothesis: ``id``, ``p``, ``label`` (1 = null, 0 = signal) and, where
needed, ``v`` (array<double> location).  Every operator takes ``by=[...]`` so that many datasets run
in one job.
"""
