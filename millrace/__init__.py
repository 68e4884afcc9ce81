"""millrace: Spark-native mining of software-change records and of the texts around them."""
