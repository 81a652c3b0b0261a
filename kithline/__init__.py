"""kithline: social-interaction analytics and training-data preparation as Spark plans."""
