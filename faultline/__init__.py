"""Incident analytics over logs, source trees and conversations, as Spark jobs."""
