"""Plan shapes that keep operators safe on large, skewed inputs."""
