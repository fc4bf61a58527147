"""Named queries, their derived input views and their oracle SQL."""
