"""Spark jobs for equity-research news, labels and fundamentals.

Layout:

* ``functions``  Column -> Column helpers (text, numbers, replies)
* ``operators``  DataFrame -> DataFrame building blocks
* ``plans``      compositions: analysis documents, prompts, daily run
* ``sources``    landed files in, result files out
* ``streaming``  the same cleaning over a landing folder
* ``catalog``    the registered queries and their SQL twins
"""
