"""graderoom: Spark-native analytics over model-generated code samples and their evaluations."""
