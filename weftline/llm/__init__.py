"""Training-data operators: archives, scans, classifiers, joins and packing over a document table."""
