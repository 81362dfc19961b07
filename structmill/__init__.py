"""Structural analytics over source trees and document collections, as Spark jobs."""
